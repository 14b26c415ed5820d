"""Context-tree weighting language model over bytes.

Texts are scored in the form lower-cased words, each followed by a space, the last by
an end byte.  Every byte is eight binary decisions; each decision (a node of the
byte's binary tree) has a tree of contexts, the last 0 .. depth bytes.  A context
node holds the Krichevsky-Trofimov estimate of the decisions seen there, and
``P = P_kt / 2 + (product over longer contexts) / 2`` mixes all depths; the chance of
a byte is the ratio of such probabilities after and before it.  Training fixes the
counts, so that the chance of a byte is a function of it and its context alone.

Counts of (context, byte) grams and of words travel as packed exchanges: distinct
grams of a document group go to buckets by the two last context bytes, where the
whole subtree below them lies together; buckets return the log chance of each gram
asked for.  Contexts of none or one byte are summed over buckets, 255 decisions for
at most 257 contexts, which is the only thing that is broadcast.

Defined results: a null or empty text is the end alone; rows that repeat count each;
rows with a null ``doc_id`` are scored and not learned from; with no training rows all
chances are those of an empty tree; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from .arrays import Words, fast_join, mix, slices, words_of

DEPTH = 5
END = 10
_END_KEY = np.uint64(0x5851F42D4C957F2D)  # the end, among word hashes
_WORD_WIDTH = 7
GROUP_BYTES, BUCKET_BYTES = 16_000_000, 6_000_000
SLICE_BYTES = 2_000_000  # of a group that is held as arrays at a time
SALTED_GROUPS = 512  # groups whose blobs one call on a bucket takes


def _grams(words: Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and byte of every place as one sortable key, last context byte on top; document bounds."""
    raw, bounds = fast_join(words)
    data = np.frombuffer(raw, dtype=np.uint8).copy()
    empty = bounds[1:] == bounds[:-1]
    data[bounds[1:][~empty] - 1] = END
    if empty.any():
        data = np.insert(data, bounds[:-1][empty], END)
        bounds = bounds + np.concatenate([[0], np.cumsum(empty)])
    wide = data.astype(np.uint64)
    key = wide << np.uint64(56 - 8 * depth)
    starts = bounds[:-1]
    for d in range(1, depth + 1):
        before = np.full(len(wide), END, dtype=np.uint64)
        before[d:] = wide[:-d] if d <= len(wide) else before[d:]
        for k in range(d):
            at = starts + k
            before[at[at < bounds[1:]]] = END
        key |= before << np.uint64(64 - 8 * d)
    return key, bounds


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    heads = np.flatnonzero(new)
    return keys[heads], np.diff(np.append(heads, len(keys)))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of several (keys, counts)."""
    if len(parts) == 1:
        return parts[0]
    keys, counts = (np.concatenate([p[i] for p in parts]) for i in range(2))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[heads], np.add.reduceat(counts[order], heads)


def _parts(table: pa.Table) -> Iterator[Words]:
    return (words_of(part.column("text"), lower=True) for batch in table.combine_chunks().to_batches() for part in slices(batch, limit=SLICE_BYTES))


def _distinct(table: pa.Table, depth: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Distinct grams and words of a group, with counts."""
    grams, words = [], []
    for part in _parts(table):
        grams.append(_counted(_grams(part, depth)[0]))
        words.append(_counted(_word_keys(part)))
    return _added(grams), _added(words)


def _word_keys(words: Words) -> np.ndarray:
    return np.concatenate([words.hashes, np.full(words.n_docs, _END_KEY, dtype=np.uint64)])


def _gram_blobs(keys: np.ndarray, vals: np.ndarray | None, g: int, bits: int, depth: int) -> list[tuple]:
    bucket = (mix(keys >> np.uint64(48)) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
    out = []
    for b in np.flatnonzero(np.diff(cuts)):
        at = order[cuts[b] : cuts[b + 1]]
        out.append((int(b), g, ex.shorten(keys[at], 0, depth + 1), None if vals is None else vals[at].astype(np.int64).tobytes(), at))
    return out


def _word_blobs(keys: np.ndarray, vals: np.ndarray | None, g: int, bits: int) -> list[tuple]:
    packed = ex.pack(g, keys, bits, vals, bucket_base=1 << bits)
    return [(b, g, ex.shorten(k, bits, _WORD_WIDTH), None if v is None else v.astype(np.int64).tobytes()) for b, _, k, v in packed]


def _send_counts(table: pa.Table, bits: int, depth: int) -> pa.Table:
    g = table.column("g")[0].as_py()
    table = table.filter(table.column("learn"))
    if not table.num_rows:
        return ex.BLOB_SCHEMA.empty_table()
    copies = table.column("copies").to_numpy()
    grams, words = [], []
    for c in np.unique(copies).tolist():  # rows that stand for several count as often
        for out, (keys, n) in zip((grams, words), _distinct(table.filter(pa.array(copies == c)), depth), strict=True):
            out.append((keys, n * c))
    rows = [r[:4] for r in _gram_blobs(*_added(grams), g, bits, depth)]
    rows += _word_blobs(*_added(words), g, bits)
    return ex.blob_table(rows, ex.BLOB_SCHEMA)


def _width(bucket: int, bits: int, depth: int) -> int:
    return depth + 1 if bucket < 1 << bits else _WORD_WIDTH


_MODEL = "bucket int, keys binary, vals binary, total long, distinct long"
_MODEL_SCHEMA = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("vals", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64())])


def _sum(table: pa.Table, bits: int, depth: int) -> pa.Table:
    bucket = table.column("bucket")[0].as_py()
    width = _width(bucket, bits, depth)
    keys = ex.lengthen(b"".join(table.column("keys").to_pylist()), width)
    counts = np.frombuffer(b"".join(table.column("vals").to_pylist()), dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    total = np.add.reduceat(counts[order], heads)
    return ex.blob_table([(bucket, ex.shorten(keys[heads], 0, width), total.tobytes(), int(total.sum()), len(total))], _MODEL_SCHEMA)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Γ(x) for x > 0, by Stirling's series after a shift of eight."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _tree(keys: np.ndarray, counts: np.ndarray, depth: int, top: int = 2) -> dict[tuple[int, int], tuple]:
    """By (context length, bit): node keys, zeros, ones, log P_kt, log P; for lengths `top` and more."""
    symbol = (keys >> np.uint64(56 - 8 * depth)) & np.uint64(255)
    out: dict[tuple[int, int], tuple] = {}
    for d in range(depth, top - 1, -1):
        code = ((keys >> np.uint64(64 - 8 * d)) << np.uint64(8)) | symbol if d else symbol
        order = np.argsort(code, kind="stable")
        code, n = code[order], counts[order]
        context, x = code >> np.uint64(8), code & np.uint64(255)
        for j in range(8):
            node = (context << np.uint64(8)) | np.uint64(1 << j) | (x >> np.uint64(8 - j))
            heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, dtype=np.int64)
            bit = ((x >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64)
            ones = np.add.reduceat(bit * n, heads) if len(heads) else np.zeros(0, dtype=np.int64)
            zeros = (np.add.reduceat(n, heads) if len(heads) else ones) - ones
            own, kt = node[heads], log_kt(zeros, ones)
            weighted = kt
            if d < depth:
                child = out[d + 1, j]
                parent = ((child[0] >> np.uint64(16)) << np.uint64(8)) | (child[0] & np.uint64(255))
                below = np.bincount(np.searchsorted(own, parent), weights=child[4], minlength=len(own))
                weighted = math.log(0.5) + np.logaddexp(kt, below)
            out[d, j] = (own, zeros, ones, kt, weighted)
    return out


_TOP = "c int, node int, below double, zeros long, ones long"
_TOP_SCHEMA = pa.schema([("c", pa.int32()), ("node", pa.int32()), ("below", pa.float64()), ("zeros", pa.int64()), ("ones", pa.int64())])


def _top_parts(batches, bits: int, depth: int):
    """For contexts of one byte: sums of the subtrees in each bucket."""
    for batch in batches:
        for bucket, raw, vals in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "vals")), strict=True):
            if bucket >= 1 << bits:
                continue
            tree = _tree(ex.lengthen(raw, depth + 1), np.frombuffer(vals, dtype=np.int64), depth)
            for j in range(8):
                node, zeros, ones, _, weighted = tree[2, j]
                spot, index = np.unique(((node >> np.uint64(16)) << np.uint64(8)) | (node & np.uint64(255)), return_inverse=True)
                index = index.ravel()
                sums = [np.bincount(index, weights=v, minlength=len(spot)) for v in (weighted, zeros, ones)]
                yield pa.RecordBatch.from_arrays([pa.array((spot >> np.uint64(8)).astype(np.int32)), pa.array((spot & np.uint64(255)).astype(np.int32)), pa.array(sums[0]), pa.array(np.rint(sums[1]).astype(np.int64)), pa.array(np.rint(sums[2]).astype(np.int64))], schema=_TOP_SCHEMA)


def _top(rows: list) -> dict[str, np.ndarray]:
    """Stop weight and chance of a one for contexts of one byte and of none."""
    below, zeros, ones = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
    for r in rows:
        below[r["c"], r["node"]], zeros[r["c"], r["node"]], ones[r["c"], r["node"]] = r["below"], r["zeros"], r["ones"]
    kt = log_kt(zeros, ones)
    weighted = math.log(0.5) + np.logaddexp(kt, below)
    n0, n1 = zeros.sum(axis=0), ones.sum(axis=0)
    kt0 = log_kt(n0, n1)
    root = math.log(0.5) + np.logaddexp(kt0, weighted.sum(axis=0))
    return {"stop1": np.exp(math.log(0.5) + kt - weighted), "one1": (ones + 0.5) / (zeros + ones + 1), "stop0": np.exp(math.log(0.5) + kt0 - root), "one0": (n1 + 0.5) / (n0 + n1 + 1)}


def log10_chances(asked: np.ndarray, keys: np.ndarray, counts: np.ndarray, top: dict[str, np.ndarray], depth: int) -> np.ndarray:
    """log10 chance of each gram asked for, from the grams of its bucket."""
    tree = _tree(keys, counts, depth)
    x = ((asked >> np.uint64(56 - 8 * depth)) & np.uint64(255)).astype(np.int64)
    c = (asked >> np.uint64(56)).astype(np.int64)
    total = np.zeros(len(asked))
    for j in range(8):
        node = (1 << j) | (x >> (8 - j))
        bit = (x >> (7 - j)) & 1
        chance = np.full(len(asked), 0.5)
        for d in range(depth, 1, -1):
            own, zeros, ones, kt, weighted = tree[d, j]
            if not len(own):
                continue
            want = ((asked >> np.uint64(64 - 8 * d)) << np.uint64(8)) | node.astype(np.uint64)
            at = np.minimum(np.searchsorted(own, want), len(own) - 1)
            here = np.where(bit == 1, ones[at], zeros[at])
            direct = (here + 0.5) / (zeros[at] + ones[at] + 1)
            stop = np.exp(math.log(0.5) + kt[at] - weighted[at]) if d < depth else np.ones(len(at))
            chance = np.where(own[at] == want, stop * direct + (1 - stop) * chance, chance)
        for stop, one in ((top["stop1"][c, node], top["one1"][c, node]), (top["stop0"][node], top["one0"][node])):
            chance = stop * np.where(bit == 1, one, 1 - one) + (1 - stop) * chance
        total += np.log10(chance)
    return total


def _send_asked(table: pa.Table, bits: int, depth: int) -> pa.Table:
    g = table.column("g")[0].as_py()
    grams, words = _distinct(table, depth)
    rows = [r[:4] for r in _gram_blobs(grams[0], None, g, bits, depth)]
    rows += _word_blobs(words[0], None, g, bits)
    return ex.blob_table(rows, ex.BLOB_SCHEMA)


def _answer(asked: pa.Table, model: pa.Table, bits: int, depth: int, top) -> pa.Table:
    if not asked.num_rows:
        return ex.REPLY_SCHEMA.empty_table()
    bucket = asked.column("bucket")[0].as_py()
    width = _width(bucket, bits, depth)
    index, distinct, groups, offsets = ex.merged(asked, width)
    keys = ex.lengthen(b"".join(model.column("keys").to_pylist()), width)
    counts = np.frombuffer(b"".join(model.column("vals").to_pylist()), dtype=np.int64)
    if bucket < 1 << bits:
        values = log10_chances(distinct, keys, counts, top.value, depth).astype(np.float32)
    else:
        values = np.zeros(len(distinct), dtype=np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
            values = np.where(keys[at] == distinct, counts[at], 0)
    values = values[index]
    return ex.blob_table([(g, bucket, 1, values[a:b].tobytes()) for g, a, b in zip(groups, offsets[:-1], offsets[1:], strict=True)], ex.REPLY_SCHEMA)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double, copies long"
_SCORES_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("n_bytes", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("copies", pa.int64())])


def _score(docs: pa.Table, replies: pa.Table, bits: int, depth: int, tokens: int, vocabulary: int) -> pa.Table:
    if not docs.num_rows:
        return _SCORES_SCHEMA.empty_table()
    got = ex.replies_of(replies, 1)
    (asked, _), (word_keys, _) = _distinct(docs, depth)
    chance = np.empty(len(asked))
    for bucket, _, _, _, at in _gram_blobs(asked, None, 0, bits, depth):
        chance[at] = np.frombuffer(got[bucket], dtype=np.float32)
    counts = np.empty(len(word_keys), dtype=np.int64)
    at = 0
    for bucket, _, part, _ in ex.pack(0, word_keys, bits, None, bucket_base=1 << bits):
        counts[at : at + len(part)] = np.frombuffer(got[bucket], dtype=np.int64)
        at += len(part)
    end = int(counts[np.searchsorted(word_keys, _END_KEY)])
    columns: list[list[np.ndarray]] = [[] for _ in range(5)]
    for words in _parts(docs):
        keys, bounds = _grams(words, depth)
        count = counts[np.searchsorted(word_keys, words.hashes)]
        log = np.concatenate([[0.0], np.cumsum(np.log10(count + 1.0) - math.log10(tokens + vocabulary + 1))])
        known = np.concatenate([[0], np.cumsum(count > 0)])
        lo, hi = words.first[:-1], words.first[1:]
        base = log[hi] - log[lo] + math.log10((end + 1) / (tokens + vocabulary + 1))
        chances = np.add.reduceat(chance[np.searchsorted(asked, keys)], bounds[:-1])
        for column, values in zip(columns, (hi - lo + 1, known[hi] - known[lo] + int(end > 0), np.diff(bounds), base, chances), strict=True):
            column.append(values)
    return pa.table([docs.column("doc_id").cast(pa.int64()), docs.column("held_out"), *(np.concatenate(c) for c in columns), docs.column("copies")], schema=_SCORES_SCHEMA)


def score(docs: DataFrame, folds: int = 7, held_out: int = 2, depth: int = DEPTH, plan: ex.Plan | None = None) -> DataFrame:
    """Log chance of every whole text under the tree, and under add-one word counts.

    Learns from the rows where ``crc32(doc_id as text) % folds`` is not `held_out`.
    """
    if not 2 <= depth <= 7:
        raise ValueError("depth must be within 2 and 7")
    plan = plan or ex.Plan(docs, group_bytes=GROUP_BYTES, bucket_bytes=BUCKET_BYTES)
    bits = plan.bits
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == held_out
    grouped = plan.grouped(docs, F.coalesce(~fold, F.lit(False)).alias("learn"), F.coalesce(fold, F.lit(False)).alias("held_out"))
    salts = math.ceil(plan.groups / SALTED_GROUPS)
    counts = ex.ask(grouped, ex.one(_send_counts, bits=bits, depth=depth))
    merge = ex.one(_sum, bits=bits, depth=depth)
    if salts > 1:
        counts = counts.withColumn("salt", F.pmod("g", F.lit(salts))).groupBy("bucket", "salt").applyInArrow(merge, schema=_MODEL)
    model = ex.materialise(counts.groupBy("bucket").applyInArrow(merge, schema=_MODEL), "context-tree")
    top = _top(model.mapInArrow(functools.partial(_top_parts, bits=bits, depth=depth), _TOP).groupBy("c", "node").agg(F.sum("below").alias("below"), F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).collect())  # 256 x 255 rows at most
    sizes = model.where(F.col("bucket") >= 1 << bits).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    shared = docs.sparkSession.sparkContext.broadcast(top)
    asked = ex.ask(grouped, ex.one(_send_asked, bits=bits, depth=depth)).withColumn("salt", F.pmod("g", F.lit(salts)))
    salted = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    replies = asked.groupBy("bucket", "salt").cogroup(salted.groupBy("bucket", "salt")).applyInArrow(ex.two(_answer, bits=bits, depth=depth, top=shared), schema=ex.REPLY)
    scored = grouped.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(ex.two(_score, bits=bits, depth=depth, tokens=sizes["n"], vocabulary=sizes["v"]), schema=_SCORES)
    per_byte = (-F.col("score") * F.lit(math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte")
    return ex.expanded(scored).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(sizes["n"]).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", per_byte)

