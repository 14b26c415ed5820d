"""Personal data: validated patterns, and boosted trees over wider candidates.

Base spans are four fixed patterns with their validators (leftmost, not overlapping
per kind, a failing match is dropped and not tried again).  Generators of high recall
propose overlapping candidates: every digit group and every run of groups, every way
to end a number after a plus sign, every four parts of dotted numbers, what stands
around an at sign (letters of any script, quotes, one label or more), and long mixed
tokens.  Gradient-boosted trees on format and context features score them;
they learn from all candidates, base spans against the rest, where
candidates inside a dropped match that would pass alone, and addresses that would pass
with plain letters, are left out.  What decides a label is no feature: numbers carry no
check digit, digit count or octet, and tokens, which are labelled by an assignment before
them, carry nothing of what stands before them, so that a token of like form is found
without one.  Numbers have to hold their kind's rule besides (`_passes`).  Equal
rows count once, and candidates of equal features become one row with their number, which
stays a Spark table; each level of a tree takes one pass over it for sums by feature and bin.
Candidates of a kind and label share one weight (`quotas`), so that a frequent kind does not
displace a rare one; built-in examples are always learned from too, so a small corpus needs
no rule of its own.

The threshold of a kind is the smallest score above which the estimated share of true
ones reaches `precision` on the held-out candidates, a third of all, each counted, with scores
told apart to one in 65,536; of the negatives, as many count as hold the rule by chance
(`CHANCE`: one number in ten passes Luhn, so for nine that fail one passes).  It is shrunk toward the threshold
of all kinds by the number of held-out positives.  Chosen candidates that overlap no base
span are added, the surest first.

Defined results: null and empty texts have no spans; rows that repeat are judged each
for itself; with no candidates nothing is added; an empty table gives no rows; other
columns are ignored by `find` and kept by `redact`.
"""

from __future__ import annotations

import functools
import itertools
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import mix, release
from .exchange import discard, materialise

KINDS = ("email", "ip", "card", "phone", "secret")
SAMPLE = 20_000  # what the candidates of all kinds and labels weigh together, against one for each example
CUTS = 24  # of a feature
UNIT = 2.0**30  # sums of gradients are whole numbers of it, so no order of tasks changes them
SCORES = 1 << 16  # steps of a score in the calibration
TASKS = 64  # of one pass over the counted features, at most: each sends its sums to the driver
PRECISION = 0.9
CHANCE = (1.0, 0.25, 1 / 9, 0.25, 1.0)  # by kind: false ones that hold the rule, for each negative
SHRINK = 20.0  # held-out positives that the threshold of all kinds counts as

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_WIDE_LOCAL = re.compile(r"[^\s@<>()\[\],;:\"]")
_WIDE_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_GROUP = re.compile(r"[0-9]+")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){2,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+")
_ASSIGNED = re.compile(r"(?:token|key|secret|password|passwd)\W{0,4}[=:]\W{0,4}$", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern, found from each at sign."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        if at >= done:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                out.append((start, m.end()))
                done = m.end()
        at = text.find("@", at + 1)
    return out


def around_at(text: str) -> list[tuple[int, int]]:
    """What may be an address around each at sign: plain and wide local parts, each with the plain, the wide and a one-label domain."""
    out, at, last = set(), text.find("@"), -1
    while at >= 0:
        plain = wide = at
        while wide > last + 1 and _WIDE_LOCAL.match(text[wide - 1]):
            wide -= 1
        while plain > wide and text[plain - 1] in _LOCAL:
            plain -= 1
        if wide < at and (m := _WIDE_DOMAIN.match(text, at + 1)):
            ends = {m.end(), at + 1 + len(m[0].split(".", 1)[0])}
            if d := _DOMAIN.match(text, at + 1):
                ends.add(d.end())
            out.update((start, end) for start in {wide, plain} - {at} for end in ends)
        last, at = at, text.find("@", at + 1)
    return sorted(out)


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of the matches that hold, and of those that were dropped."""
    kept, lost = [(0, a, b) for a, b in emails(text)] if "@" in text else [], []
    if not _GROUP.search(text):
        return kept, lost
    if "." in text:
        for m in _IP.finditer(text):
            (kept if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")) else lost).append((1, *m.span()))
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        (kept if 13 <= len(d) <= 19 and luhn(d) else lost).append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            (kept if 9 <= len(_digits(m[0])) <= 15 else lost).append((3, *m.span()))
    return kept, lost


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of everything that might be personal, overlaps included."""
    out: set[tuple[int, int, int]] = {(0, a, b) for a, b in [*emails(text), *around_at(text)]} if "@" in text else set()
    if not _GROUP.search(text):
        return sorted(out)
    for m in _DOTTED.finditer(text):
        parts = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m[0])]
        out.update((1, a, b) for (a, _), (_, b) in zip(parts, parts[3:], strict=False))
    for m in _CARD.finditer(text):
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in _GROUP.finditer(m[0])]
        for i, (start, _) in enumerate(groups):
            size = 0
            for a, b in itertools.islice(groups, i, None):
                size += b - a
                if size > 19:
                    break
                if size >= 12:
                    out.add((2, start, b))
    at = text.find("+")
    while at >= 0:
        if m := _PHONE.match(text, at):
            size = 0
            for g in _GROUP.finditer(m[0]):
                size += g.end() - g.start()
                if size > 15:
                    break
                if size >= 9:
                    out.add((3, at, at + g.end()))
        at = text.find("+", at + 1)
    for m in _TOKEN.finditer(text):
        s = m[0]
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
            out.add((4, *m.span()))
    return sorted(out)


def _class(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


def features(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    rows = []
    for kind, a, b in spans:
        s = text[a:b]
        groups = [len(g) for g in _GROUP.findall(s)] or [0]
        before = text[max(0, a - 14) : a] if kind != 4 else ""  # what labels a token stands there
        separators = len(set(re.findall(r"[^0-9]+", s.strip("+")))) if kind in (2, 3) else 0
        # a token's case and digits tell made ones from long words and slugs
        digits, upper = sum("0" <= c <= "9" for c in s), sum("A" <= c <= "Z" for c in s)
        form = (digits / (b - a), upper / (b - a), len(re.findall(r"[0-9]+|[A-Za-z]+", s)) / (b - a)) if kind == 4 else (0, 0, 0)
        rows.append(
            (kind, b - a if kind in (0, 4) else 0, sum(c.isalpha() for c in s), len(groups) if kind != 1 else 0, groups[0] if kind != 4 else 0, groups[-1] if kind not in (1, 4) else 0, max(groups) - min(groups) if kind != 1 else 0, separators, _class(before[-1:]), _class(text[b : b + 1]), s.count("(") + s.count(")"), s.count("-"), s.count("_"), len(set(s)) / (b - a), "=" in before or ":" in before, sum(c.isalpha() for c in before), bool(re.fullmatch("[0-9a-f]+", s)), *form, s.rpartition("@")[2].count(".") if kind == 0 else 0)
        )
    share, power = np.frexp(np.array(rows, dtype=np.float64).reshape(len(spans), N_FEATURES))
    return np.ldexp(np.rint(share * 256) / 256, power)  # eight binary digits, so that a feature has few values


N_FEATURES = 21
#: Kinds whose added spans have to hold the rule of their base spans.
_RULED = (1, 2, 3)


def _passes(text: str, span: tuple[int, int, int]) -> bool:
    kept, _ = base_spans(text[span[1] : span[2]])
    return (span[0], 0, span[2] - span[1]) in kept


def _mask(text: str, spans: list[tuple[int, int, int]]) -> bytearray:
    """A byte for each character, 1 where a span lies."""
    out = bytearray(len(text))
    for _, a, b in spans:
        out[a:b] = b"\1" * (b - a)
    return out


def _plain(s: str) -> bool:
    """Whether an address would pass if its letters and quotes were plain ones."""
    s = re.sub(r"[^\W_]|['!#$&*/=?^`{|}~]", "a", s)
    return emails(s) == [(0, len(s))]


def weak_labels(text: str, spans: list[tuple[int, int, int]]) -> list[int]:
    """1: a base span (or, for tokens, an assigned one); 0: not; -1: left out of training."""
    kept, lost = base_spans(text)
    good, mail = set(kept), _mask(text, [s for s in kept if s[0] == 0])
    dropped = {kind: _mask(text, [s for s in lost if s[0] == kind]) for kind in {s[0] for s in lost}}
    out = []
    for span in spans:
        if span[0] == 4:
            out.append(int(bool(_ASSIGNED.search(text[max(0, span[1] - 14) : span[1]]))))
        elif span in good:
            out.append(1)
        elif span[0] == 0:
            whole = not text[max(0, span[1] - 1) : span[1]].isalpha()  # else it cuts a word
            out.append(-1 if whole and mail.find(1, span[1], span[2]) < 0 and _plain(text[span[1] : span[2]]) else 0)
        elif span[0] in dropped and dropped[span[0]].find(1, span[1], span[2]) >= 0 and _passes(text, span):
            out.append(-1)
        else:
            out.append(0)
    return out


@dataclass
class Trees:
    """Boosted regression trees on the logistic loss, of small depth, over binned features."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.25
    start: float = 0.0
    rows: int = 0  # candidates that were learned from
    held: int = 0  # and those that decided the thresholds
    trees: list = field(default_factory=list)
    thresholds: dict = field(default_factory=dict)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, corpus: Candidates | None = None) -> Trees:
        """Learn from the given rows and from all that are counted in `corpus`."""
        weight, n = np.ones(len(y)) if weight is None else weight, np.ones(len(y))
        cuts = _cuts(x, weight, corpus.values() if corpus else [])
        at_start = corpus.weights() if corpus else (0.0, 0.0)
        p = min(max(((weight * y).sum() + at_start[1]) / (weight.sum() + at_start[0]), 1e-3), 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        for _ in range(self.rounds):
            splits: dict[int, tuple[int, float]] = {}
            leaves: dict[int, float] = {}
            for level in range(self.depth):
                sums = _sums(self, x, y, n, weight, splits, level, cuts)
                if corpus:
                    sums += corpus.sums(self, splits, level, cuts)
                if level == 0:
                    self.rows = int(sums[0, 0, :, 2].sum())
                for i, of_node in enumerate(sums, 1 << level):
                    self._split(i, of_node, cuts, splits, leaves)
            self.trees.append(_tree(1, splits, leaves))
        return self

    def _split(self, i: int, sums: np.ndarray, cuts: list[np.ndarray], splits: dict, leaves: dict) -> None:
        g, h = np.cumsum(sums[:, :, 0], axis=1) / UNIT, np.cumsum(sums[:, :, 1], axis=1) / UNIT
        total_g, total_h, rows = g[0, -1], h[0, -1], sums[0, :, 2].sum()
        leaf = lambda a, b: float(self.rate * a / (b + 1.0))
        leaves.setdefault(i, leaf(total_g, total_h))
        if rows < 20:
            return
        best = (1e-6, -1, 0)
        for f, c in enumerate(cuts):
            left_g, left_h = g[f, : len(c)], h[f, : len(c)]
            gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        _, f, k = best
        if f >= 0 and 0 < sums[f, : k + 1, 2].sum() < rows:
            splits[i] = (f, float(cuts[f][k]))
            leaves[2 * i], leaves[2 * i + 1] = leaf(g[f, k], h[f, k]), leaf(total_g - g[f, k], total_h - h[f, k])

    def _values(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        return np.where(x[:, f] <= cut, self._values(low, x), self._values(high, x))

    def score(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for tree in self.trees:
            score += self._values(tree, x)
        return score

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.score(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float, by_chance: tuple[float, ...] = (1.0,) * len(KINDS), corpus: Candidates | None = None) -> Trees:
        kind, chance, true, false = x[:, 0].astype(int), self.chance(x), (y == 1).astype(float), (y == 0).astype(float)
        if corpus:
            kind, chance, true, false = (np.concatenate(c) for c in zip((kind, chance, true, false), corpus.scores(self), strict=True))
        self.held = int(true.sum() + false.sum())
        false = false * np.array(by_chance)[kind]
        pooled = _smallest(chance, true, false, precision)
        for k in range(len(KINDS)):
            at = kind == k
            n = float(true[at].sum())
            self.thresholds[k] = (n * _smallest(chance[at], true[at], false[at], precision) + SHRINK * pooled) / (n + SHRINK)
        return self


def _cuts(x: np.ndarray, weight: np.ndarray, counted: list[tuple[int, float, float]]) -> list[np.ndarray]:
    """Weighted quantiles of each feature, over given rows and (feature, value, weight) of others."""
    more = np.array(counted, dtype=np.float64).reshape(-1, 3)
    out = []
    for f in range(x.shape[1]):
        own = more[more[:, 0] == f]
        values, place = np.unique(np.concatenate([x[:, f], own[:, 1]]), return_inverse=True)
        share = np.cumsum(np.bincount(place, np.concatenate([weight, own[:, 2]])))
        out.append(np.unique(values[np.minimum(np.searchsorted(share, np.linspace(0.02, 0.98, CUTS) * share[-1]), len(values) - 1)]))
    return out


def _sums(trees: Trees, x: np.ndarray, y: np.ndarray, n: np.ndarray, weight: np.ndarray, splits: dict, level: int, cuts: list[np.ndarray]) -> np.ndarray:
    """Gradients, their slopes and numbers of rows, by node of the level, feature and bin, as whole numbers."""
    node = np.ones(len(y), dtype=np.int64)
    for i in sorted(splits):
        f, cut = splits[i]
        here = node == i
        node[here] = 2 * i + (x[here, f] > cut)
    p = 1 / (1 + np.exp(-trees.score(x)))
    parts = [np.rint((y - p) * weight * n * UNIT), np.rint(p * (1 - p) * weight * n * UNIT), n]
    here = node >= 1 << level
    node, x, parts = node[here] - (1 << level), x[here], [v[here] for v in parts]
    size = CUTS + 1
    out = np.zeros((1 << level, len(cuts), size, 3))
    for f, c in enumerate(cuts):
        place = node * size + np.searchsorted(c, x[:, f], side="left")
        for k, v in enumerate(parts):
            out[:, f, :, k] = np.bincount(place, v, size << level).reshape(-1, size)
    return out


def _tree(i: int, splits: dict, leaves: dict):
    return (*splits[i], _tree(2 * i, splits, leaves), _tree(2 * i + 1, splits, leaves)) if i in splits else leaves[i]


def _read(batch: pa.RecordBatch, share: dict[tuple[int, int], float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels, numbers and weights of counted candidates."""
    x = np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype=np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    y, n = batch.column("y").to_numpy(), batch.column("n").to_numpy().astype(np.float64)
    return x, y, n, np.array([share[k, v] for k, v in zip(x[:, 0].astype(int).tolist(), y.tolist(), strict=True)], dtype=np.float64)


def _pass_sums(batches, share, trees: Trees, splits: dict, level: int, cuts: list[np.ndarray]):
    out = None
    for batch in batches:
        x, y, n, weight = _read(batch, share)
        own = _sums(trees, x, y, n, weight, splits, level, cuts)
        out = own if out is None else out + own
    if out is not None:
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])


def _pass_values(batches, share):
    for batch in batches:
        x, _, n, weight = _read(batch, share)
        for f in range(N_FEATURES):
            values, place = np.unique(x[:, f], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), f, dtype=np.int32)), pa.array(values), pa.array(np.rint(np.bincount(place, n * weight * UNIT)).astype(np.int64))], names=["f", "value", "w"])


def _pass_scores(batches, share, trees: Trees):
    for batch in batches:
        x, y, n, _ = _read(batch, share)
        step = np.minimum((trees.chance(x) * SCORES).astype(np.int64), SCORES - 1)
        n = n.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int32)), pa.array(step), pa.array(np.where(y == 1, n, 0)), pa.array(np.where(y == 0, n, 0))], names=["kind", "step", "yes", "no"])


@dataclass
class Candidates:
    """All candidates of a corpus as a stored table (kind, y, held, x, n), and the weight of one by kind and label."""

    table: DataFrame
    counts: dict[tuple[int, int], int]
    share: dict[tuple[int, int], float]

    def _over(self, held: bool, function, schema: str, **fixed) -> DataFrame:
        of = self.table.where("held" if held else "not held").select("y", "x", "n").coalesce(TASKS)
        return of.mapInArrow(functools.partial(function, share=self.share, **fixed), schema)

    def weights(self) -> tuple[float, float]:
        """What all weigh that are learned from, and the positives."""
        found = self.table.where("not held").groupBy("kind", "y").agg(F.sum("n").alias("n")).orderBy("kind", "y").collect()
        of = [(r["y"], r["n"] * self.share[r["kind"], r["y"]]) for r in found]
        return sum(w for _, w in of), sum(w for y, w in of if y)

    def values(self) -> list[tuple[int, float, float]]:
        found = self._over(False, _pass_values, "f int, value double, w long").groupBy("f", "value").agg(F.sum("w").alias("w")).collect()
        return [(r["f"], r["value"], r["w"] / UNIT) for r in found]

    def sums(self, trees: Trees, splits: dict, level: int, cuts: list[np.ndarray]) -> np.ndarray:
        found = self._over(False, _pass_sums, "sums binary", trees=trees, splits=splits, level=level, cuts=cuts).collect()
        return sum((np.frombuffer(r["sums"]).reshape(1 << level, len(cuts), CUTS + 1, 3) for r in found), np.zeros((1 << level, len(cuts), CUTS + 1, 3)))

    def scores(self, trees: Trees) -> tuple[np.ndarray, ...]:
        """Kind, score, number of true and of false ones, of all that are held out."""
        found = self._over(True, _pass_scores, "kind int, step long, yes long, no long", trees=trees).groupBy("kind", "step").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).collect()
        kind, step, yes, no = np.array([tuple(r) for r in found], dtype=np.int64).reshape(-1, 4).T
        return kind, step / SCORES, yes.astype(float), no.astype(float)


def _smallest(chance: np.ndarray, true: np.ndarray, false: np.ndarray, precision: float) -> float:
    """The smallest score from which on true ones are `precision` of all; 1 if there is none."""
    order = np.argsort(-chance, kind="stable")
    p, good, bad = chance[order], np.cumsum(true[order]), np.cumsum(false[order])
    fits = np.flatnonzero((good >= precision * (good + bad)) & np.append(p[1:] < p[:-1], True)[: len(p)])
    return float(p[fits[-1]]) if len(fits) else 1.0


def _hashes(doc: int | None, text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """A hash of the place of each candidate in the corpus."""
    kind, start, end = np.array(spans, dtype=np.int64).T.astype(np.uint64)
    own = mix(mix(np.array([doc or 0], dtype=np.int64).view(np.uint64)) + np.uint64(zlib.crc32(text.encode())))
    return mix(mix(own + start) + end * np.uint64(8) + kind)


def quotas(counts: dict[tuple[int, int], int], sample: int) -> dict[tuple[int, int], int]:
    """What the candidates of each (kind, label) weigh together: equal shares, and what small strata leave goes to the larger ones."""
    out, left = {}, sample
    for i, s in enumerate(sorted(counts, key=lambda s: (counts[s], s))):
        out[s] = min(counts[s], left // (len(counts) - i))
        left -= out[s]
    return out


def _training_rows(batches):
    """Features, as bytes, and weak labels of all candidates that have one."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part, rows = batch.slice(lo, 1000), []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                if not text or not (spans := candidates(text)):
                    continue
                labels = weak_labels(text, spans)
                x = features(text, spans).astype(np.float32)
                rows += [(s[0], y, h, v.tobytes()) for s, y, h, v in zip(spans, labels, _hashes(doc, text, spans).view(np.int64).tolist(), x, strict=True) if y >= 0]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["kind", "y", "h", "x"])


@functools.lru_cache(maxsize=1)
def examples() -> dict[tuple[int, int], list[list[float]]]:
    """Features of candidates of fixed made-up texts, by kind and weak label."""
    rng = random.Random(7)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(3, 9)))
    texts = []
    for i in range(600):
        size = rng.choice((13, 14, 15, 16, 16, 16, 17, 18, 19))
        number = digits(size - 1)
        good = next(number + c for c in "0123456789" if luhn(number + c))
        card = good if i % 2 else digits(size)
        step = rng.choice((1, 2, 3, 4, 4, 4, size, size, size))
        card = rng.choice(" -").join(card[k : k + step] for k in range(0, size, step))
        ip = ".".join(str(rng.randint(0, 255 if i % 2 else 700)) for _ in range(4))
        phone = "+" + rng.choice(("{} {} {}", "{} ({}) {}", "{}-{}-{}", "{}{}{}")).format(digits(rng.randint(1, 2)), digits(3), digits(rng.randint(6, 8) if i % 3 else 3))
        mail = f"{word()}{rng.choice(('', '.', '_', '+'))}{word()}@{word()}" + rng.choice((".com", ".org", ".co.uk", f".{word()}.net") if i % 3 else ("",))
        token = "".join(rng.choices("0123456789abcdef" if i % 4 < 2 else "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", k=rng.randint(20, 64)))
        # unassigned ones are names and slugs: a made token is a secret wherever it stands
        held = rng.choice(("token", "api_key", "secret", "password")) + rng.choice((" = ", "=", ": ", ' = "'))
        slug = rng.choice("-_").join([word(), word(), rng.choice((digits(2), digits(4), f"v{digits(1)}")), word(), word(), word()][: rng.randint(4, 6)])
        held, token = (held, token) if i % 2 else (f"{word()} ", slug.upper() if i % 8 == 0 else slug)
        before, after = rng.choice((" ", " ", ": ", " (", "\n")), rng.choice((" ", " ", ".", ",", ")", "\n"))
        texts += [f"{word()}{before}{s}{after}{word()}" for s in (card, ip, phone, mail, held + token)]
    # what is left of an address behind a letter of another script is no address
    texts += [f"{word()} {word()}{rng.choice('äöüéñ')}{word()}@{word()}{rng.choice('äöüéñ')}{word()}.{rng.choice(('de', 'org', 'com'))} {word()}" for _ in range(120)]
    out: dict[tuple[int, int], list[list[float]]] = {}
    for text in texts:
        spans = candidates(text)
        for s, y, x in zip(spans, weak_labels(text, spans), features(text, spans).tolist(), strict=True):
            if y >= 0:
                out.setdefault((s[0], y), []).append(x)
    return out


def gather(docs: DataFrame, sample: int = SAMPLE) -> Candidates:
    """All candidates of the corpus, counted by their features; a third is held out."""
    rows = docs.select("doc_id", "text").mapInArrow(_training_rows, "kind int, y int, h long, x binary")
    # equal rows have equal candidates: one of them counts, before the shuffle
    once = rows.groupBy("kind", "y", "h").agg(F.min("x").alias("x"))
    counted = once.groupBy("kind", "y", (F.pmod("h", F.lit(3)) == 0).alias("held"), "x").agg(F.count(F.lit(1)).alias("n"))
    table = materialise(counted, "candidates")
    counts = {(r["kind"], r["y"]): r["n"] for r in table.groupBy("kind", "y").agg(F.sum("n").alias("n")).collect()}
    return Candidates(table, counts, {s: n / counts[s] for s, n in quotas(counts, sample).items()})


def train(docs: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> Trees:
    """Trees and thresholds from all candidates of the corpus, which together weigh as `sample` examples at most."""
    corpus = gather(docs, sample)
    learned = [(y, x) for (_, y), xs in sorted(examples().items()) for x in xs]
    y, x = (np.array(c, dtype=np.float64) for c in zip(*learned, strict=True))
    held = np.arange(len(y)) % 3 == 0
    more = corpus if corpus.counts else None
    trees = Trees().fit(x[~held], y[~held], corpus=more).calibrate(x[held], y[held], precision, CHANCE, more)
    discard(corpus.table)
    return trees


def _select(texts: list[str | None], trees: Trees) -> list[tuple[list, list]]:
    """Base spans and added spans of each text."""
    out, spans_of, xs, masks = [], [], [], []
    for i, text in enumerate(texts):
        base, _ = base_spans(text) if text else ([], [])
        masks.append(_mask(text, base) if text else bytearray())
        own = [s for s in candidates(text) if masks[i].find(1, s[1], s[2]) < 0] if text else []
        out.append((base, []))
        spans_of += [(i, s) for s in own]
        if own:
            xs.append(features(text, own))
    if spans_of:
        x = np.concatenate(xs)
        p = trees.chance(x)
        chosen = [k for k in np.argsort(-p, kind="stable").tolist() if p[k] >= trees.thresholds[spans_of[k][1][0]]]
        for k in chosen:
            i, s = spans_of[k]
            if masks[i].find(1, s[1], s[2]) < 0 and (s[0] not in _RULED or _passes(texts[i], s)):
                out[i][1].append(s)
                masks[i][s[1] : s[2]] = b"\1" * (s[2] - s[1])
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


_FOUND_SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def _find(batches, trees: Trees):
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            found = _select(part.column("text").to_pylist(), trees)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)), pa.array([_joined(base) for base, _ in found]), pa.array([_joined(base + added) for base, added in found]), pa.array([len(added) for _, added in found], pa.int64())], schema=_FOUND_SCHEMA)


def find(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans, n_added); spans as kind:start:end in code points."""
    trees = trees or train(docs)
    return docs.select("doc_id", "text").mapInArrow(functools.partial(_find, trees=trees), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long")


def _redact(batches, trees: Trees):
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            texts = part.column("text").to_pylist()
            out = []
            for text, (base, added) in zip(texts, _select(texts, trees), strict=True):
                if base or added:
                    pieces, end = [], 0
                    for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
                        if a >= end:
                            pieces += [text[end:a], f"<{KINDS[kind].upper()}>"]
                        end = max(end, b)
                    text = "".join([*pieces, text[end:]])
                out.append(text)
            yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(out, part.schema.field("text").type))
        release()


def redact(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """`docs` with each span of its texts replaced by its kind in angle brackets."""
    trees = trees or train(docs)
    return docs.mapInArrow(functools.partial(_redact, trees=trees), docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The checksum form of `find`."""
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")
