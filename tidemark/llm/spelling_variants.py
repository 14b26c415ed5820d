"""Groups of spelling variants, by full neighbourhood generation.

The vocabulary is what the corpus holds often enough.  For every word all distinct
deletions, replacements and insertions over the alphabet of the vocabulary are generated,
as rolling hashes of whole arrays of words; those that a bitmap of the vocabulary's hashes
lets through are written out and joined with the vocabulary by their text.  A candidate
that meets a word differs from its origin by one code point, so no distance is computed.

Defined results: null texts have no words; a null ``doc_id`` counts as an empty id where
the id alters words; rows that repeat count each time; an empty table, or one without
frequent words, gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmap, crc
from . import exchange as ex
from .arrays import LOWER, Words, _powers_for, mix, slices, text_buffer, words_inside
from .skew import heavy_keys, lookup

_BASE = 0x9E3779B97F4A7C15
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
SLICE = 4_000_000  # bytes of text whose words are counted together
CELLS = 4_000_000  # candidates that are hashed at once


def letter_runs(column) -> Words:
    """Maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A to Z lower-cased."""
    data, offsets = text_buffer(column)
    lead = data == 0xC3  # of U+00C0 to U+00FF, and of nothing else
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    return words_inside(LOWER[data], offsets, inside)


def _altered(words: Words, ids: list, modulus: int) -> tuple[np.ndarray, list[str]]:
    """Places of the words that the id alters, and what they become."""
    names = [("" if d is None else str(d)).encode() + b":" for d in ids]
    heads = np.array([zlib.crc32(x) for x in names], dtype=np.uint32)
    own = crc.ranges(words.data, words.start, words.end)
    h = crc.joined(heads[words.doc], own, words.end - words.start)
    at = np.flatnonzero(h % np.uint32(modulus) == 0)
    out = []
    for i in at.tolist():
        word = words.data[words.start[i] : words.end[i]].tobytes().decode()
        cut = int(h[i]) % len(word)
        out.append(word[:cut] + word[cut + 1 :])
    return at, out


def _counted(batches, least: int, modulus: int):
    """(word, n) of every slice; words of fewer than `least` code points are left out."""
    for table in (part for batch in batches for part in slices(batch, limit=SLICE)):
        words = letter_runs(table.column("text"))
        at, changed = _altered(words, table.column("doc_id").to_pylist(), modulus)
        # a byte that continues a code point does not count
        points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
        use = points[words.end] - points[words.start] >= least
        use[at] = False
        kept = np.flatnonzero(use)
        _, first, n = np.unique(words.hashes[kept], return_index=True, return_counts=True)
        start, end = words.start[kept[first]], words.end[kept[first]]
        texts = [words.data[a:b].tobytes().decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        more = [w for w in changed if len(w) >= least]
        yield pa.RecordBatch.from_arrays([pa.array(texts + more, pa.string()), pa.array(n.tolist() + [1] * len(more), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, modulus: int = 199) -> DataFrame:
    """(word, n) of the words that occur often enough, stored in the shared folder.

    A run loses one code point, chosen by its checksum with the document's id, where
    `modulus` divides that checksum.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    counted = rows.mapInArrow(functools.partial(_counted, least=least_length, modulus=modulus), "word string, n long")
    return ex.materialise(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count), "vocabulary")


def _matrix(words: list[str]) -> np.ndarray:
    """Code points of words of one length, one row for each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1).astype(np.uint64)


def _sums(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all prefixes, of all suffixes): sum of point * base ** places to its right."""
    size = points.shape[1]
    before = np.zeros((len(points), size + 1), dtype=np.uint64)
    after = np.zeros((len(points), size + 1), dtype=np.uint64)
    powers = _powers_for(_BASE, size)
    for i in range(size):
        before[:, i + 1] = before[:, i] * np.uint64(_BASE) + points[:, i]
        after[:, size - 1 - i] = after[:, size - i] + points[:, size - 1 - i] * powers[i]
    return before, after


def _hashes(batches):
    for batch in batches:
        by_length: dict[int, list[str]] = {}
        for w in batch.column("word").to_pylist():
            by_length.setdefault(len(w), []).append(w)
        for words in by_length.values():
            before, _ = _sums(_matrix(words))
            yield pa.RecordBatch.from_arrays([pa.array(mix(before[:, -1]).view(np.int64))], names=["h"])


def neighbours(points: np.ndarray, alphabet: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of one kind of neighbours as (word, place, letter), and which are distinct from all before."""
    size = points.shape[1]
    powers = _powers_for(_BASE, size + 2)
    before, after = _sums(points)
    if kind == "deletion":
        # of a letter that repeats, the first one goes
        h = before[:, :size] * powers[size - 1 - np.arange(size)] + after[:, 1:]
        fresh = np.ones(h.shape, dtype=bool)
        fresh[:, 1:] = points[:, 1:] != points[:, :-1]
        return h[:, :, None], fresh[:, :, None]
    if kind == "replacement":
        left = (before[:, :size] * np.uint64(_BASE))[:, :, None] + alphabet
        return left * powers[size - 1 - np.arange(size)][None, :, None] + after[:, 1:, None], points[:, :, None] != alphabet
    # an insertion after an equal letter is the one before it
    left = (before * np.uint64(_BASE))[:, :, None] + alphabet
    fresh = np.ones(left.shape, dtype=bool)
    fresh[:, 1:] = points[:, :, None] != alphabet
    return left * powers[size - np.arange(size + 1)][None, :, None] + after[:, :, None], fresh


def _spelled(word: str, place: int, letter: str, kind: str) -> str:
    return word[:place] + ("" if kind == "deletion" else letter) + word[place + (kind != "insertion") :]


def _candidates(batches, alphabet: str, flags: Broadcast):
    """(word, candidate) for the distinct neighbours that the bitmap lets through."""
    letters = _matrix([alphabet])[0]
    for batch in batches:
        by_length: dict[int, list[str]] = {}
        for w in batch.column("word").to_pylist():
            by_length.setdefault(len(w), []).append(w)
        for size, words in by_length.items():
            share = max(1, CELLS // ((size + 1) * len(letters)))
            for lo in range(0, len(words), share):
                part = words[lo : lo + share]
                points, origin, found = _matrix(part), [], []
                for kind in ("deletion", "replacement", "insertion"):
                    h, fresh = neighbours(points, letters, kind)
                    maybe = bitmap.maybe(flags.value, mix(h.ravel())).reshape(h.shape) & fresh
                    for i, place, letter in zip(*(x.tolist() for x in np.nonzero(maybe)), strict=True):
                        origin.append(part[i])
                        found.append(_spelled(part[i], place, alphabet[letter], kind))
                yield pa.RecordBatch.from_arrays([pa.array(origin, pa.string()), pa.array(found, pa.string())], names=["word", "candidate"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of words of a stored vocabulary one code point apart."""
    # the alphabet has one row for each code point that occurs
    alphabet = "".join(sorted(r["c"] for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()))
    if not alphabet:
        return words.select("word", F.lit("").alias("near"), F.col("n").alias("near_n")).where("false")
    flags = bitmap.build(ex.materialise(words.select("word").mapInArrow(_hashes, "h long"), "hashes"))
    made = words.select("word").repartition(_tasks(words)).mapInArrow(functools.partial(_candidates, alphabet=alphabet, flags=flags), "word string, candidate string")
    return made.join(words.select(F.col("word").alias("candidate"), F.col("n").alias("near_n")), "candidate").select("word", F.col("candidate").alias("near"), "near_n")


def _tasks(words: DataFrame) -> int:
    """Tasks for generation: words of the vocabulary make hundreds of candidates each."""
    return max(words.sparkSession.sparkContext.defaultParallelism, words.count() // 20_000)


def group_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, factor: int = 5, modulus: int = 199, max_rounds: int = 40) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for each word of the vocabulary.

    ``form`` is the near word of largest count, ties to the smallest in code-point order,
    if it is `factor` times as frequent; ``root`` is where forms lead to.
    """
    words = vocabulary(docs, least_length, least_count, modulus)
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    enough = -F.col("best.down") >= F.lit(factor) * F.col("n")
    rows = ex.materialise(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.down")).alias("form_n")), "forms")
    ex.discard(words)
    # counts grow by the factor along a chain, and every round halves what is left of it
    roots = ex.materialise(rows.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = ex.materialise(lookup(roots, up, ["root"], "left", heavy_keys(roots, ["root"])), "roots")
        ex.discard(roots)
        roots = moved.select("word", F.coalesce("next", "root").alias("root"))
        if moved.where("next is not null").isEmpty():
            return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    raise RuntimeError(f"forms did not end in {max_rounds} rounds")
