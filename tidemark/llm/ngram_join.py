"""Similarity self-join of documents on word n-gram sets, as a blocked sparse product.

Documents with equal sets form one class.  Each class representative keeps the
n-grams that another class has too, rarest first; the first ones (the prefix that
the size bound leaves) decide which representatives can link at all.  These fall
into families by shared prefix n-grams.  Within a family the product of the
document by n-gram incidence matrix with its transpose is accumulated over blocks
of columns, between tiles of bounded size, and pairs below the bound that their
two sizes give are discarded.  A large family is first compared with its most
central member; members that link to it need no comparison among each other, as
they are connected already.  Two tiles meet only if they share a prefix n-gram, lie
within the size bound, and have as many n-grams that any other document has as a
link between their sizes needs.  Tiles return spanning links only, so no step makes
a row for each pair of a group, and no link between classes is lost.

Defined results: null and empty texts have an empty set and link with nothing; a
text of fewer words than ``n`` has its whole word sequence as one n-gram; rows that
repeat are one class, and rows of one id with other texts are judged each for itself; rows with a null ``doc_id`` take part only through their
class, whose smallest non-null id is used (null if it has none); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from .arrays import Words, slices, words_of
from .components import components
from .skew import heavy_keys, lookup
from .substring_dedup import _Runs

TILE = 384  # documents of a tile
COLUMNS = 2048  # n-grams of a column block


def _sets(table: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of every document: hashes, document bounds, word counts."""
    words: Words = words_of(table.column("text"), lower=True)
    hashes, ok = words.windows(n)
    at = np.flatnonzero(ok)
    doc, key = words.doc[at], hashes[at]
    count = np.diff(words.first)
    for k in range(1, n):
        few = np.flatnonzero(count == k)
        if len(few):
            short, _ = words.windows(k, salt=k)
            doc, key = np.concatenate([doc, few]), np.concatenate([key, short[words.first[few]]])
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    doc, key = doc[new], key[new]
    return key, np.searchsorted(doc, np.arange(words.n_docs + 1)), count


def _signatures(key: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    raw = np.ascontiguousarray(key).tobytes()
    return [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _describe(batches, n: int):
    for table in (part for batch in batches for part in slices(batch)):
        key, bounds, _ = _sets(table, n)
        yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks().cast(pa.int64()), table.column("th").combine_chunks(), pa.array(np.diff(bounds).astype(np.int64)), pa.array(_signatures(key, bounds), type=pa.binary())], names=["doc_id", "th", "n_shingles", "sig"])


def _representatives(docs: pa.Table, marks: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets of the rows that stand for a class: hashes, bounds, and the numbers of the classes."""
    key, bounds, _ = _sets(docs, n)
    wanted = {(d, s): c for d, s, c, k in zip(*(marks.column(x).to_pylist() for x in ("doc_id", "vals", "node", "kind")), strict=True) if k == 0}
    chosen, ids = [], []
    for i, (d, s) in enumerate(zip(docs.column("doc_id").to_pylist(), _signatures(key, bounds), strict=True)):
        if (d, s) in wanted:
            chosen.append(i)
            ids.append(wanted.pop((d, s)))
    lengths = np.diff(bounds)[chosen] if chosen else np.zeros(0, dtype=np.int64)
    keys = np.concatenate([key[bounds[i] : bounds[i + 1]] for i in chosen]) if chosen else key[:0]
    return keys, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), np.array(ids, dtype=np.int64)


def _send_counts(docs: pa.Table, marks: pa.Table, n: int, bits: int) -> pa.Table:
    if not docs.num_rows:
        return ex.BLOB_SCHEMA.empty_table()
    g = docs.column("g")[0].as_py()
    keys, _, _ = _representatives(docs, marks, n)
    runs = _Runs(keys, np.arange(len(keys)))
    count = np.minimum(np.diff(np.append(runs.heads, len(keys))), 3).astype(np.uint8)
    rows = []
    for bucket, _, part, c in ex.pack(g, runs.keys, bits, count):
        cells = np.frombuffer(ex.shorten(part, bits, 5), dtype=np.uint8).reshape(-1, 5).copy()
        cells[:, -1] = (cells[:, -1] & 0xFC) | c
        rows.append((bucket, g, cells.tobytes(), None))
    return ex.blob_table(rows, ex.BLOB_SCHEMA)


def _merge_counts(table: pa.Table) -> pa.Table:
    """How common each n-gram is, on a logarithmic scale; 0: one document only."""
    raws, groups = table.column("keys").to_pylist(), table.column("g").to_pylist()
    bucket = table.column("bucket")[0].as_py()
    offsets = np.concatenate([[0], np.cumsum([len(r) // 5 for r in raws])])
    cells = ex.lengthen(b"".join(raws), 5)
    count = ((cells >> np.uint64(24)) & np.uint64(3)).astype(np.int64)
    runs = _Runs(cells & ~(np.uint64(3) << np.uint64(24)), np.arange(len(cells)))
    total = runs.reduce(np.add, count)
    grade = np.minimum(255, np.floor(8 * np.log2(np.maximum(total, 1)))).astype(np.uint8)
    answer = np.zeros(len(cells), dtype=np.uint8)
    answer[runs.at] = grade[runs.number]
    rows = [(g, bucket, 1, answer[a:b].tobytes()) for g, a, b in zip(groups, offsets[:-1], offsets[1:], strict=True)]
    return ex.blob_table(rows, ex.REPLY_SCHEMA)


_ALIVE = "doc_id long, n long, n_shared long, prefix int, weight double, grams binary"
_ALIVE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("n_shared", pa.int64()), ("prefix", pa.int32()), ("weight", pa.float64()), ("grams", pa.binary())])


def _alive(docs: pa.Table, replies: pa.Table, n: int, bits: int, percent: int) -> pa.Table:
    """Representatives that can link, with their shared n-grams, rarest first."""
    if not docs.num_rows:
        return _ALIVE_SCHEMA.empty_table()
    keys, bounds, ids = _representatives(docs, replies, n)
    runs = _Runs(keys, np.arange(len(keys)))
    grades, at, got = np.zeros(len(runs.keys), dtype=np.uint8), 0, ex.replies_of(replies, 1)
    for bucket, _, part, _ in ex.pack(0, runs.keys, bits):
        grades[at : at + len(part)] = np.frombuffer(got[bucket], dtype=np.uint8)
        at += len(part)
    grade = np.empty(len(keys), dtype=np.uint8)
    grade[runs.at] = grades[runs.number]
    rows = []
    for d, a, b in zip(ids.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        size, own = b - a, int((grade[a:b] == 0).sum())
        prefix = size - -(-percent * size // 100) + 1 - own
        if prefix > 0 and size > own:
            k, c = keys[a:b], grade[a:b]
            order = np.lexsort((k, c))[own:]
            rows.append((d, size, size - own, min(prefix, size - own), float(c.mean()), k[order].tobytes()))
    return ex.blob_table(rows, _ALIVE_SCHEMA)


def _prefix_keys(batches):
    for batch in batches:
        ids, keys = [], []
        for d, p, raw in zip(batch.column("doc_id").to_pylist(), batch.column("prefix").to_pylist(), batch.column("grams").to_pylist(), strict=True):
            part = np.frombuffer(raw, dtype=np.int64)[:p]
            ids.append(np.full(len(part), d, dtype=np.int64))
            keys.append(part)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(keys))], names=["doc_id", "gram"])


def linked(left: list[np.ndarray], right: list[np.ndarray], size_l: np.ndarray, size_r: np.ndarray, percent: int) -> np.ndarray:
    """Which of left x right link: overlaps accumulated over blocks of n-gram columns."""
    every = np.concatenate([*left, *right])
    values, column, count = np.unique(every, return_inverse=True, return_counts=True)
    column = column.ravel()
    order = np.cumsum(count > 1) - 1  # columns of one document add nothing
    column = np.where(count[column] > 1, order[column], -1)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    use = column >= 0
    column, row = column[use], row[use]
    by = np.argsort(column, kind="stable")
    column, row = column[by], row[by]
    overlap = np.zeros((len(left), len(right)), dtype=np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        block = np.zeros((len(left) + len(right), COLUMNS), dtype=np.float32)
        block[row[a:b], column[a:b] - lo] = 1
        overlap += block[: len(left)] @ block[len(left) :].T
    overlap = np.rint(overlap).astype(np.int64)
    return 100 * overlap >= percent * (size_l[:, None] + size_r[None, :] - overlap)


def _spanning(ids: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Star edges of the components that the pairs (of row numbers) make."""
    root = np.arange(len(ids))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in pairs.tolist():
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(int(ids[i]), int(ids[r])) for i in range(len(ids)) if (r := find(i)) != i]


_EDGES = "a long, b long"
_EDGE_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _tile(table: pa.Table, percent: int) -> pa.Table:
    """Links within the families of a bin, or between the two tiles of a pair."""
    family = table.column("family").to_numpy()
    side = table.column("side").to_numpy()
    ids, size = table.column("doc_id").to_numpy(), table.column("n").to_numpy()
    grams = [np.frombuffer(x, dtype=np.int64) for x in table.column("grams").to_pylist()]
    edges: list[tuple[int, int]] = []
    order = np.lexsort((ids, family))
    for part in np.split(order, np.flatnonzero(np.diff(family[order])) + 1):
        left = part[side[part] != 2]
        right = part[side[part] != 1]
        if not len(left) or not len(right):
            continue
        ok = linked([grams[i] for i in left], [grams[i] for i in right], size[left], size[right], percent)
        i, j = np.nonzero(ok)
        place = {int(x): k for k, x in enumerate(part)}
        pairs = np.array([(place[int(left[x])], place[int(right[y])]) for x, y in zip(i, j, strict=True) if left[x] != right[y]]).reshape(-1, 2)
        edges += _spanning(ids[part], pairs)
    return ex.blob_table(edges, _EDGE_SCHEMA)


def _to_pivot(batches, percent: int):
    for batch in batches:
        ok = []
        for a, x, b, y in zip(*(batch.column(c).to_pylist() for c in ("n", "grams", "pivot_n", "pivot_grams")), strict=True):
            both = len(np.intersect1d(np.frombuffer(x, dtype=np.int64), np.frombuffer(y, dtype=np.int64), assume_unique=True))
            ok.append(100 * both >= percent * (a + b - both))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("pivot"), pa.array(ok, type=pa.bool_())], names=["doc_id", "pivot", "core"])


FINE = 8  # size steps of a class: documents that link differ by at most so many and one


def _placed(large: DataFrame, core: DataFrame, anchors: DataFrame, percent: int) -> DataFrame:
    """(doc_id, tile, family, step, kind, n_shared, n) of the members of large families.

    A tile holds about `TILE` documents of a family and a size step that share their
    smallest prefix n-gram where they can.
    """
    width = math.log(100 / percent) / FINE + 1e-9
    rows = large.select("doc_id", "family", "n", "n_shared").join(core, "doc_id").join(anchors, "doc_id")
    rows = rows.withColumns({"step": F.floor(F.log("n") / F.lit(width)).cast("int"), "kind": F.when(F.col("core"), "c").otherwise("r")})
    rows = ex.materialise(rows.drop("core"), "places")
    cell = ["family", "step", "kind"]
    cells = rows.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("tiles"))
    rows = ex.materialise(lookup(rows, cells, cell, "inner", heavy_keys(rows, cell)).withColumn("spot", F.pmod("anchor", "tiles")).drop("anchor", "tiles"), "places")
    spots = rows.groupBy(*cell, "spot").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("shares"))
    rows = lookup(rows, spots, [*cell, "spot"], "inner", heavy_keys(rows, [*cell, "spot"]))
    share = F.pmod(F.xxhash64("doc_id"), "shares")
    return ex.materialise(rows.select("doc_id", F.concat_ws(":", *cell, "spot", share).alias("tile"), *cell, "n", "n_shared"), "places")


def _tile_pairs(places: DataFrame, postings: DataFrame, percent: int) -> DataFrame:
    """Pairs of tiles that share a prefix n-gram and whose sizes and shared n-grams allow a link."""
    facts = places.groupBy("tile", "step", "kind").agg(F.min("n").alias("least"), F.max("n_shared").alias("most"))
    held = ex.materialise(postings.join(places.select("doc_id", "tile"), "doc_id").select("gram", "tile").distinct(), "held")
    several = held.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("gram")
    held = lookup(held, several, ["gram"], "inner", heavy_keys(held, ["gram"]))
    one_, two_ = (held.select("gram", F.col("tile").alias(t)) for t in ("t1", "t2"))
    near = one_.join(two_, "gram").where("t1 < t2").select("t1", "t2").distinct()
    near = near.unionByName(facts.where("kind = 'r'").select(F.col("tile").alias("t1"), F.col("tile").alias("t2")))
    for k in "12":
        near = near.join(facts.select(*(F.col(c).alias(c[0] + k if c == "tile" else c + k) for c in facts.columns)), f"t{k}")
    possible = (F.lit(100 + percent) * F.least("most1", "most2") >= F.lit(percent) * (F.col("least1") + F.col("least2"))) & (F.abs(F.col("step1") - F.col("step2")) <= FINE)
    return near.where(possible & ~((F.col("kind1") == "c") & (F.col("kind2") == "c"))).select("t1", "t2")


def _large_edges(large: DataFrame, postings: DataFrame, percent: int) -> DataFrame:
    """Spanning links within families of more than a tile."""
    pivots = large.groupBy("family", "m").agg(F.max_by("doc_id", F.struct("weight", "doc_id")).alias("pivot"))
    pivots = pivots.join(large.select(F.col("doc_id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("grams").alias("pivot_grams")), "pivot")
    # members meet their pivot in shares of a tile, each with a copy of it
    shares = F.ceil(F.col("m") / F.lit(TILE)).cast("int")
    pivots = ex.materialise(pivots.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("m"), "pivots")
    met = large.withColumn("share", F.pmod(F.xxhash64("doc_id"), shares)).join(pivots, ["family", "share"])
    core = met.select("doc_id", "n", "grams", "pivot", "pivot_n", "pivot_grams").mapInArrow(functools.partial(_to_pivot, percent=percent), "doc_id long, pivot long, core boolean")
    core = ex.materialise(core, "core")
    to_pivot = core.where("core and doc_id <> pivot").select(F.col("doc_id").alias("a"), F.col("pivot").alias("b"))
    # postings are ordered by document and n-gram hash; the smallest hash draws like documents together
    anchors = postings.groupBy("doc_id").agg(F.min("gram").alias("anchor"))
    places = _placed(large, core.select("doc_id", "core"), anchors, percent)
    pairs = ex.materialise(_tile_pairs(places, postings, percent), "pairs")
    side = F.when(F.col("t1") == F.col("t2"), 0).otherwise(1)
    roles = pairs.select(F.col("t1").alias("tile"), "t1", "t2", side.alias("side")).unionByName(pairs.where("t1 <> t2").select(F.col("t2").alias("tile"), "t1", "t2", F.lit(2).alias("side")))
    paired = roles.join(places.select("doc_id", "tile", "family"), "tile").join(large.select("doc_id", "n", "grams"), "doc_id")
    tiled = paired.select("family", "side", "doc_id", "n", "grams", "t1", "t2").groupBy("t1", "t2").applyInArrow(ex.one(_tile, percent=percent), schema=_EDGES)
    return to_pivot.unionByName(tiled)


def _family_edges(alive: DataFrame, families: DataFrame, postings: DataFrame, percent: int) -> DataFrame:
    """Spanning links of all representatives that link."""
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("m"))
    sized = lookup(families, sizes, ["family"], "inner", heavy_keys(families, ["family"]))
    members = ex.materialise(alive.join(sized, "doc_id"), "members")
    small = members.where(F.col("m") <= TILE)
    bins = max(1, math.ceil(small.count() / TILE))
    edges = small.select("family", F.lit(0).alias("side"), "doc_id", "n", "grams", F.pmod(F.xxhash64("family"), F.lit(bins)).alias("bin")).groupBy("bin").applyInArrow(ex.one(_tile, percent=percent), schema=_EDGES)
    large = members.where(F.col("m") > TILE)
    return edges if large.isEmpty() else edges.unionByName(_large_edges(large, postings, percent))


def dealt(docs: DataFrame, plan: ex.Plan) -> DataFrame:
    """Rows with their group, by id and text, so that rows of one id are no hot group."""
    return docs.withColumn("g", _group(plan, F.xxhash64("text")))


def _group(plan: ex.Plan, text_hash):
    return F.pmod(F.xxhash64("doc_id", text_hash), F.lit(plan.groups)).cast("int")


def link_components(docs: DataFrame, n: int = 5, percent: int = 80, plan: ex.Plan | None = None, stored: bool = False) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id), one row for each row of docs.

    Two documents link when ``100 * |A ∩ B| >= percent * |A ∪ B|`` for their sets of
    distinct ``n``-word shingles.  ``class_id`` is the smallest id with an equal set,
    ``component_id`` the smallest id that links reach.  With `stored`, docs is what
    `exchange.stored_groups` made of `dealt` rows, and texts are not shuffled.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be within 50 and 100")
    plan = plan or ex.Plan(docs)
    bits = plan.bits
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    described = ex.materialise(texts.mapInArrow(functools.partial(_describe, n=n), "doc_id long, th long, n_shingles long, sig binary"), "sets")
    named = described.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "th")).alias("r"))
    classes = ex.materialise(named.select("sig", "r.doc_id", "r.th").withColumns({"g": _group(plan, F.col("th")), "node": F.monotonically_increasing_id()}), "classes")
    # only rows with an id stand for a class
    grouped = docs.select("g", "doc_id", "text") if stored else dealt(plan.reduced(docs.select("doc_id", "text").where("doc_id is not null")).drop("copies"), plan).repartition(plan.parts, "g")
    marks = classes.select("g", F.lit(0).alias("bucket"), F.lit(0).alias("kind"), F.col("sig").alias("vals"), "doc_id", "node")
    by_group = grouped.groupBy("g")
    blobs = by_group.cogroup(marks.groupBy("g")).applyInArrow(ex.two(_send_counts, n=n, bits=bits), schema=ex.BLOB)
    replies = ex.answer(blobs, _merge_counts).withColumns({c: F.lit(None).cast("long") for c in ("doc_id", "node")}).unionByName(marks)
    alive = ex.materialise(by_group.cogroup(replies.groupBy("g")).applyInArrow(ex.two(_alive, n=n, bits=bits, percent=percent), schema=_ALIVE), "alive")
    postings = ex.materialise(alive.select("doc_id", "prefix", "grams").mapInArrow(_prefix_keys, "doc_id long, gram long"), "postings")
    first = postings.groupBy("gram").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("last")).where("b < last")
    shared = lookup(postings, first.select("gram", "b"), ["gram"], "inner", heavy_keys(postings, ["gram"]))
    families = components(shared.select(F.col("doc_id").alias("a"), "b")).withColumnsRenamed({"node": "doc_id", "component": "family"})
    edges = ex.materialise(_family_edges(alive, families, postings, percent), "links")
    found = components(edges)
    for table in (alive, postings, families, edges):
        ex.discard(table)
    # classes are numbered, so that rows of one id with other texts are apart; the ids come back here
    reach = ex.materialise(classes.join(found, "node", "left").select("sig", F.col("doc_id").alias("class_id"), F.coalesce("component", "node").alias("component")), "reach")
    least = reach.groupBy("component").agg(F.min("class_id").alias("least"))
    reach = ex.materialise(lookup(reach, least, ["component"], "inner", heavy_keys(reach, ["component"])).select("sig", "class_id", "least"), "reach")
    out = lookup(described, reach, ["sig"], "left", heavy_keys(described, ["sig"]))
    return out.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("least", "doc_id").alias("component_id"))
