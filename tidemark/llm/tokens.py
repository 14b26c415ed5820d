"""Token ids of whole texts, equal to those of a byte-level BPE file of ``tokenizers``."""

from __future__ import annotations

import base64
import functools
import os

import numpy as np


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as ``tokenizers`` gives them with ``add_special_tokens=False``.

    Where the vocabulary also lies beside the file as ranks, the merging itself runs
    in ``tiktoken``, which is several times faster; both are compared on a probe when
    the file is loaded, and texts that hold a special token's string always go
    through ``tokenizers``.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        size = self.whole.get_vocab_size(with_added_tokens=True)
        self.kind = "<u2" if size <= 1 << 16 else "<u4"
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.encode = self._slow
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
            fast = functools.partial(tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_to_numpy, disallowed_special=())
            probe = " The naïve 12,345 don't ...\n\n \tDie Öffnung — ¿qué? 漢字 '' s's"
            if fast(probe).tolist() == self._slow(probe).tolist():
                self.encode = fast

    def _slow(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint32)
        return (self._slow if any(s in text for s in self.special) else self.encode)(text)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
