"""Near duplicates by bottom-k sketches of one hash function.

A document's set of word shingles is hashed once and keeps its `SKETCH` smallest values.
Documents with equal sets form one class.  Inverted lists are kept for runs of
consecutive retained values: two sets above the similarity agree on most of the smallest
values of their union, and so on some run of them (`run_lengths` and `longest_run` give
the lengths for which a link shares no list with a chance below `MISS`; sets that fit their
sketch always share one).  Every list first generates pairs with its least document only.
Pairs whose union sketch estimates too small an overlap are dropped, the others are compared
on their full sets, and what links becomes one component.  Documents of lists that then
still hold several components are sought by their rarest retained values: a link shares so
many values that it shares one of those.  Documents of a value that few have are compared
by their sketches where it lies; what may link, and all documents of a common value, meet
in tiles of bounded size, where the same estimate and the same comparison find the links
between components; tiles meet if they share such a pair or value and return spanning links.
So no step makes a row for each pair of copies, and no candidate is capped.

Defined results: null and empty texts have an empty set and link with nothing; a text of
fewer words than `n` has its whole word sequence as one shingle; each row is judged by its
own text, rows that repeat are one class; rows with a null ``doc_id`` take part only
through their class, whose smallest non-null id is used (null if it has none); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import bitmap
from . import exchange as ex
from .arrays import mix, slices
from .components import components
from .ngram_join import _sets, _signatures, _spanning, linked
from .skew import heaviest, heavy_keys, lookup

SKETCH = 64
RUN = 3
MISS = 1e-9  # accepted chance of overlooking one link
SHORT = 64  # documents of a value whose pairs are looked at one by one
BIN = 4096  # rows of such values that a task takes at once
LOAD = 400_000  # set values that members of one comparison task, or of a tile, have
TILE = 1024  # documents of a tile
COLUMNS = 2048  # values of a column block
_PAD = np.array([-1, -2], dtype=np.int64).view(np.uint64)  # fill short sketches of either side


def longest_run(percent: int, size: int, most: int = RUN) -> int:
    """The longest run, up to `most`, whose absence among `size` values of a union is rarer than `MISS`."""
    p = percent / 100
    for r in range(most, 0, -1):
        state = [1.0] + [0.0] * (r - 1)  # chance of having met no run, by the length of the current one
        for _ in range(size):
            state = [(1 - p) * sum(state), *(p * x for x in state[:-1])]
        if sum(state) < MISS:
            return r
    raise ValueError("the sketch is too small for this similarity")


def run_lengths(n: int, percent: int, most: int = RUN) -> range:
    """Lengths of the runs to index for a set of n values: every link of sets that fit their sketch shares one."""
    least = most
    for common in range(max(1, -(-percent * n // 100)), n + 1):
        apart = common * (100 - percent) // percent
        if apart:  # equal sets are one class already
            least = min(least, -(-common // (apart + 1)))
    return range(least, most + 1)


def least_common(percent: int, size: int) -> int:
    """Fewer common values than this among the `size` least of a union are rarer than `MISS` for a link."""
    p, chance = percent / 100, 0.0
    for t in range(size + 1):
        chance += math.comb(size, t) * p**t * (1 - p) ** (size - t)
        if chance > MISS:
            return t
    return size


def _describe(batches, n: int, k: int):
    for table in (part for batch in batches for part in slices(batch)):
        key, bounds, _ = _sets(table, n)
        raw = np.ascontiguousarray(key).tobytes()
        sketches = [raw[8 * a : 8 * min(b, a + k)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [table.column("doc_id").combine_chunks().cast(pa.int64()), table.column("th").combine_chunks(), pa.array(np.diff(bounds).astype(np.int64)), pa.array(_signatures(key, bounds), type=pa.binary()), pa.array(sketches, type=pa.binary())],
            names=["doc_id", "th", "n_shingles", "sig", "sketch"],
        )


def _padded(raws: list[bytes], k: int, pad: int) -> np.ndarray:
    """Sketches as rows of k values."""
    out = np.full((len(raws), k), _PAD[pad], dtype=np.uint64)
    length = np.array([len(r) // 8 for r in raws], dtype=np.int64)
    out[np.arange(k)[None, :] < length[:, None]] = np.frombuffer(b"".join(raws), dtype=np.uint64)
    return out


def _list_keys(batches, k: int, percent: int, most: int):
    """(list, node, n): runs of consecutive retained values as inverted-list keys."""
    for batch in batches:
        node, n = batch.column("node").to_numpy(), batch.column("n").to_numpy()
        values = _padded(batch.column("sketch").to_pylist(), k, 0)
        held = np.minimum(n, k)
        by_size = {int(s): run_lengths(int(s), percent, most) for s in np.unique(held)}
        parts = []
        for r in range(1, most + 1):
            run = np.full((len(n), max(0, k - r + 1)), r, dtype=np.uint64)
            for j in range(r):
                run = mix(run ^ values[:, j : k - r + 1 + j])
            uses = np.array([r in by_size[int(s)] for s in held], dtype=bool)
            row, place = np.nonzero(uses[:, None] & (np.arange(run.shape[1])[None, :] <= (held - r)[:, None]))
            parts.append((run[row, place].view(np.int64), node[row], n[row]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["list", "node", "n"])


def _of_several(postings: DataFrame, firsts: DataFrame, hot: Sequence[Row] = ()) -> DataFrame:
    """Postings whose list may be one of `firsts`: most lists have one document and are dropped where they lie.

    Those of `hot` lists, rows of `firsts`, get their `least` and `m` here and need no join;
    for the others both are null.
    """
    turned = F.shiftleft("list", 32).bitwiseOR(F.shiftrightunsigned("list", 32))
    probes = ex.materialise(firsts.select(F.explode(F.array("list", turned)).alias("h")), "probes")
    known = np.array(sorted((r["list"], r["least"], r["m"]) for r in hot), dtype=np.int64).reshape(-1, 3)
    fields = ", ".join(f"{c} long" for c in [*postings.columns, "least", "m"])
    out = postings.mapInArrow(functools.partial(_listed, flags=bitmap.build(probes), known=known), fields)
    ex.discard(probes)
    return out


def _listed(batches, flags: Broadcast, known: np.ndarray):
    for batch in batches:
        key = batch.column("list").to_numpy().view(np.uint64)
        turned = (key << np.uint64(32)) | (key >> np.uint64(32))
        rows = batch.filter(pa.array(bitmap.maybe(flags.value, key) & bitmap.maybe(flags.value, turned)))
        list_ = rows.column("list").to_numpy()
        met = np.isin(list_, known[:, 0])
        facts = np.zeros((len(list_), 2), dtype=np.int64)
        facts[met] = known[np.searchsorted(known[:, 0], list_[met]), 1:]
        yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(f, mask=~met) for f in facts.T)], names=[*rows.schema.names, "least", "m"])


def overlaps(left: np.ndarray, right: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of padded sketches: common values among the k least of the union, and all common ones."""
    both = np.sort(np.concatenate([left, right], axis=1), axis=1)
    twice = np.zeros(both.shape, dtype=bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] < _PAD[1])
    rank = np.cumsum(~twice, axis=1)
    return (twice & (rank <= k)).sum(axis=1), twice.sum(axis=1)


def _estimate(batches, k: int, percent: int, least: int):
    """Pairs whose union sketch allows a link; `sure` where the sketches are the full sets."""
    for batch in batches:
        a_n, b_n = batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy()
        near, common = overlaps(_padded(batch.column("a_sketch").to_pylist(), k, 0), _padded(batch.column("b_sketch").to_pylist(), k, 1), k)
        sure = (a_n <= k) & (b_n <= k)
        links = np.where(sure, 100 * common >= percent * (a_n + b_n - common), (near >= least) & (100 * np.minimum(a_n, b_n) >= percent * np.maximum(a_n, b_n)))
        at = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(at)), batch.column("b").take(pa.array(at)), pa.array(sure[at])], names=["a", "b", "sure"])


def _full_sets(batches, n: int, flags: Broadcast):
    """Sets of the rows that may be wanted, one of each text and id in a task."""
    seen: set[int] = set()
    for table in (part for batch in batches for part in slices(batch)):
        h = table.column("h").to_numpy()
        keep = bitmap.maybe(flags.value, h.view(np.uint64))
        at = [i for i in np.flatnonzero(keep).tolist() if not (int(h[i]) in seen or seen.add(int(h[i])))]
        table = table.take(pa.array(at, pa.int64()))
        if not at:
            continue
        key, bounds, _ = _sets(table, n)
        raw = np.ascontiguousarray(key).tobytes()
        grams = [raw[8 * a : 8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), table.column("th").combine_chunks(), pa.array(grams, type=pa.binary())], names=["doc_id", "th", "grams"])


_EDGE_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _confirm(table: pa.Table, percent: int) -> pa.Table:
    """Links between the pivot of a task and its members, on full sets."""
    pivots, members = [], []
    for node, raw, member in zip(table.column("node").to_pylist(), table.column("grams").to_pylist(), table.column("member").to_pylist(), strict=True):
        (members if member else pivots).append((node, np.frombuffer(raw, dtype=np.uint64)))
    b, full = pivots[0]
    out = []
    for a, grams in members:
        place = np.minimum(np.searchsorted(full, grams), len(full) - 1)
        common = int((full[place] == grams).sum())
        if 100 * common >= percent * (len(full) + len(grams) - common):
            out.append((a, b))
    return ex.blob_table(out, _EDGE_SCHEMA)


def _pair_sketches(pairs: DataFrame, classes: DataFrame, k: int, percent: int, least: int, name: str) -> DataFrame:
    """Stored pairs that the estimate lets through."""
    a, b = (classes.select(F.col("node").alias(s), F.col("n").alias(f"{s}_n"), F.col("sketch").alias(f"{s}_sketch")) for s in "ab")
    left = ex.materialise(pairs.join(a, "a"), "sketched")
    whole = lookup(left, b, ["b"], "inner", heavy_keys(left, ["b"]))
    out = ex.materialise(whole.mapInArrow(functools.partial(_estimate, k=k, percent=percent, least=least), "a long, b long, sure boolean"), name)
    ex.discard(left)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Stored links among estimated pairs: full sets of members meet that of `b`, in tasks of a bounded load."""
    open_ = pairs.where(~F.col("sure")).select("a", "b")
    sized = ex.materialise(open_.join(sets.select(F.col("node").alias("a"), "n"), "a"), "sized")
    loads = sized.groupBy("b").agg(F.ceil(F.sum("n") / F.lit(LOAD)).cast("int").alias("tasks"))
    spread = lookup(sized, loads, ["b"], "inner", heavy_keys(sized, ["b"])).select("a", "b", F.pmod(F.xxhash64("a"), "tasks").alias("task"))
    spread = ex.materialise(spread, "spread")
    members = spread.join(sets.select(F.col("node").alias("a"), "grams"), "a").select("b", "task", F.col("a").alias("node"), "grams", F.lit(True).alias("member"))
    pivots = spread.select("b", "task").distinct().join(sets.select(F.col("node").alias("b"), "grams"), "b").select("b", "task", F.col("b").alias("node"), "grams", F.lit(False).alias("member"))
    found = members.unionByName(pivots).groupBy("b", "task").applyInArrow(ex.one(_confirm, percent=percent), schema="a long, b long")
    out = ex.materialise(found.unionByName(pairs.where("sure").select("a", "b")), "links")
    ex.discard(sized)
    ex.discard(spread)
    return out


def _labelled(rows: DataFrame, edges: DataFrame, node: str, label: str) -> DataFrame:
    """Rows with the component of a node; none has more than its postings, so no key is heavy."""
    found = components(edges).select(F.col("node").alias(node), F.col("component").alias(label))
    return rows.join(found, node, "left").withColumn(label, F.coalesce(label, node))


_SEEN_SCHEMA = pa.schema([("t1", pa.string()), ("t2", pa.string()), ("node", pa.int64()), ("side", pa.int32())])


def _sides(table: pa.Table):
    """Of every family of a bin, or of a pair of tiles: its rows, and those that meet as left and right."""
    family, side, node = (table.column(c).to_numpy() for c in ("family", "side", "node"))
    order = np.lexsort((node, family))
    for part in np.split(order, np.flatnonzero(np.diff(family[order])) + 1):
        left, right = part[side[part] != 2], part[side[part] != 1]
        if len(left) and len(right):
            yield part, left, right


def _likely(table: pa.Table, percent: int, least: int) -> pa.Table:
    """Documents of two tiles that have a likely partner of another component, by how many marks of the sketches agree."""
    n, component = table.column("n").to_numpy(), table.column("component").to_numpy()
    marks = [np.frombuffer(x, dtype=np.uint32) for x in table.column("marks").to_pylist()]
    chosen: set[int] = set()
    for _, left, right in _sides(table):
        i, j = np.nonzero(_allowed(shared([marks[q] for q in left], [marks[q] for q in right]), n, component, left, right, percent, least))
        chosen.update(left[np.unique(i)].tolist(), right[np.unique(j)].tolist())
    return table.select(["t1", "t2", "node", "side"]).take(pa.array(sorted(chosen), pa.int64())).cast(_SEEN_SCHEMA)


def _allowed(common: np.ndarray, n: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, least: int) -> np.ndarray:
    """Pairs of different components with sizes near enough and enough common values in their sketches."""
    small, large = np.minimum(n[left][:, None], n[right][None, :]), np.maximum(n[left][:, None], n[right][None, :])
    return (component[left][:, None] != component[right][None, :]) & (100 * small >= percent * large) & (common >= np.minimum(least, -(-percent * large // 100)))


def _meet(table: pa.Table, k: int, percent: int, least: int) -> pa.Table:
    """Spanning links between components, within the families of a bin or between the two tiles of a pair.

    Overlaps of sketches come from their values' incidence, the union sketch decides which
    pairs go on, and the documents of those are compared on their full sets.
    """
    n, component, node = (table.column(c).to_numpy() for c in ("n", "component", "node"))
    raws, sets = table.column("sketch").to_pylist(), table.column("grams").to_pylist()
    values = lambda rows: [np.frombuffer(raws[q], dtype=np.int64) for q in rows]
    full = lambda rows: [np.frombuffer(sets[q], dtype=np.int64) for q in rows]
    edges: list[tuple[int, int]] = []
    for part, left, right in _sides(table):
        i, j = np.nonzero(_allowed(shared(values(left), values(right)), n, component, left, right, percent, least))
        keep = np.ones(len(i), dtype=bool)
        for lo in range(0, len(i), 4096):
            x, y = left[i[lo : lo + 4096]], right[j[lo : lo + 4096]]
            near, both = overlaps(_padded([raws[q] for q in x], k, 0), _padded([raws[q] for q in y], k, 1), k)
            sure = (n[x] <= k) & (n[y] <= k)
            keep[lo : lo + 4096] = np.where(sure, 100 * both >= percent * (n[x] + n[y] - both), near >= least)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        own, other = np.unique(i), np.unique(j)
        ok = linked(full(left[own]), full(right[other]), n[left[own]], n[right[other]], percent)
        met = ok[np.searchsorted(own, i), np.searchsorted(other, j)]
        place = {int(x): q for q, x in enumerate(part)}
        edges += _spanning(node[part], np.array([(place[int(x)], place[int(y)]) for x, y in zip(left[i[met]], right[j[met]], strict=True)]).reshape(-1, 2))
    return ex.blob_table(edges, _EDGE_SCHEMA)


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each of left has in common with each of right."""
    every, row = np.concatenate([*left, *right]), np.repeat(np.arange(len(left) + len(right)), [len(x) for x in [*left, *right]])
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    number = np.cumsum(new) - 1
    often = np.bincount(number) > 1  # a value of one document adds nothing
    column = np.where(often[number], (np.cumsum(often) - 1)[number], -1)
    row, column = row[column >= 0], column[column >= 0]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        block = np.zeros((len(left) + len(right), COLUMNS), dtype=np.float32)
        block[row[a:b], column[a:b] - lo] = 1
        out += block[: len(left)] @ block[len(left) :].T
    return np.rint(out).astype(np.int64)


def _tiles(lists: DataFrame, percent: int) -> DataFrame:
    """(node, family, component, n, step, tile, pure, single): documents of lists with several components, dealt to tiles.

    `lists` has (list, node, n, component, lo), with the least component of a list.  Lists that
    share components make a family.  A tile has documents of one family and of
    like size; those of a large component have tiles of their own, which need not be
    compared among each other.  A small family is whole (`single`).
    """
    families = components(lists.where("component <> lo").select(F.col("component").alias("a"), F.col("lo").alias("b")).distinct()).select(F.col("node").alias("component"), F.col("component").alias("family"))
    nodes = ex.materialise(lists.select("node", "component", "n").distinct(), "members")
    nodes = ex.materialise(lookup(nodes, families, ["component"], "inner", heavy_keys(nodes, ["component"])), "members")
    width = math.log(100 / percent) * (1 + 1e-9)  # documents that link differ by one step at most
    of_family = nodes.groupBy("family").agg(((F.count(F.lit(1)) <= TILE) & (F.sum("n") <= LOAD)).alias("single"))
    sized = ex.materialise(lookup(nodes, of_family, ["family"], "inner", heavy_keys(nodes, ["family"])).withColumn("step", F.floor(F.log("n") / F.lit(width)).cast("int")), "members")
    large = sized.where("not single")
    own = large.groupBy("family", "component").agg((F.count(F.lit(1)) >= TILE).alias("pure"))
    large = ex.materialise(lookup(large, own, ["family", "component"], "inner", heavy_keys(large, ["family", "component"])).withColumn("kind", F.when(F.col("pure"), F.col("component")).otherwise(F.lit(-1))), "members")
    cell = ["family", "kind", "step"]
    cells = large.groupBy(*cell).agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(TILE), F.sum("n") / F.lit(LOAD))).cast("int").alias("tiles"))
    placed = lookup(large, cells, cell, "inner", heavy_keys(large, cell))
    fields = ["node", "family", "component", "n", "step", "single"]
    tile = F.concat_ws(":", *cell, F.pmod(F.xxhash64("node"), "tiles"))
    out = placed.select(*fields, tile.alias("tile"), "pure").unionByName(sized.where("single").select(*fields, F.lit(None).cast("string").alias("tile"), F.lit(False).alias("pure")))
    return ex.materialise(out, "tiles")


CELL_BITS_MOST, CELL_BLOCK = 26, 16


def _cells(raws: list[bytes], bits: int) -> np.ndarray:
    """Cells of retained values; these are small, so they are mixed again."""
    return (mix(np.frombuffer(b"".join(raws), dtype=np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _cell_counts(batches, bits: int):
    """Counts of the cells of a batch, one row for each block of cells."""
    for batch in batches:
        cell, count = np.unique(_cells(batch.column("sketch").to_pylist(), bits), return_counts=True)
        block, at = np.unique(cell >> CELL_BLOCK, return_index=True)
        parts = [(int(b), c.astype(np.int32).tobytes(), k.astype(np.int32).tobytes()) for b, c, k in zip(block, np.split(cell & ((1 << CELL_BLOCK) - 1), at[1:]), np.split(count, at[1:]), strict=True)] if len(cell) else []
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True) if parts else ((), (), ()), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "cells", "counts"])


def _grades(members: DataFrame, k: int) -> tuple[Broadcast, int]:
    """How common retained values are among the stored members, on a logarithmic scale, by cell; 0: one document only.

    There are at most `2 ** CELL_BITS_MOST` cells (64 MB).  Values that share a cell count as
    more common than they are, which changes their order alone.
    """
    bits = min(max(2 * k * members.count(), 1 << CELL_BLOCK).bit_length(), CELL_BITS_MOST)

    def grade(table: pa.Table) -> pa.Table:
        cell, count = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=np.int32) for c in ("cells", "counts"))
        total = np.bincount(cell, weights=count, minlength=1 << CELL_BLOCK)
        out = np.minimum(255, np.floor(8 * np.log2(np.maximum(total, 1)))).astype(np.uint8)
        return pa.table({"block": table.column("block").slice(0, 1), "grades": pa.array([out.tobytes()], pa.binary())})

    counts = members.select("sketch").mapInArrow(functools.partial(_cell_counts, bits=bits), "block int, cells binary, counts binary")
    out = np.zeros(1 << bits, dtype=np.uint8)
    for b in counts.groupBy("block").applyInArrow(grade, schema="block int, grades binary").collect():
        out[b["block"] << CELL_BLOCK : (b["block"] + 1) << CELL_BLOCK] = np.frombuffer(b["grades"], dtype=np.uint8)
    return members.sparkSession.sparkContext.broadcast(out), bits


def _rarest(batches, k: int, percent: int, least: int, grades: Broadcast, bits: int):
    """(list, node, n, component): of every member the rarest retained values, one of which each link shares.

    A link has `need` values of the sketch in common at least (`_allowed`), so one of them is
    among the first `held - need + 1` in any order that all members share.
    """
    for batch in batches:
        raws, n = batch.column("sketch").to_pylist(), batch.column("n").to_numpy()
        held = np.minimum(n, k)
        values, doc = np.frombuffer(b"".join(raws), dtype=np.uint64), np.repeat(np.arange(len(n)), held)
        common = grades.value[_cells(raws, bits)]
        order = np.lexsort((values, common, doc))
        place = np.arange(len(order)) - np.repeat(np.cumsum(held) - held, held)
        first = held - np.minimum(least, -(-percent * n // 100)) + 1
        at = order[(place < first[doc]) & (common[order] > 0)]
        columns = [values[at].view(np.int64), *(batch.column(c).to_numpy()[doc[at]] for c in ("node", "n", "component"))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["list", "node", "n", "component"])


_PAIR = "a long, b long, a_n long, b_n long, a_component long, b_component long"


def _near_pairs(table: pa.Table, k: int, percent: int, least: int) -> pa.Table:
    """Pairs of documents of one value that may link, by their components, their sizes and the marks of their sketches."""
    table = table.take(pa.array(np.lexsort((table.column("node").to_numpy(), table.column("list").to_numpy()))))
    list_, node, n, component = (table.column(c).to_numpy() for c in ("list", "node", "n", "component"))
    found = []
    for d in range(1, len(list_)):
        i = np.flatnonzero(list_[d:] == list_[:-d])
        if not len(i):
            break
        small, large = np.minimum(n[i], n[i + d]), np.maximum(n[i], n[i + d])
        i = i[(component[i] != component[i + d]) & (100 * small >= percent * large)]
        found.append(np.stack([i, i + d]))
    i, j = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
    _, at = np.unique(np.stack([node[i], node[j]]), axis=1, return_index=True)
    i, j = i[at], j[at]
    raws = [np.frombuffer(x, dtype=np.uint32).astype(np.uint64).tobytes() for x in table.column("marks").to_pylist()]
    keep = np.zeros(len(i), dtype=bool)
    for lo in range(0, len(i), 4096):
        x, y = i[lo : lo + 4096], j[lo : lo + 4096]
        _, both = overlaps(_padded([raws[q] for q in x], k, 0), _padded([raws[q] for q in y], k, 1), k)
        keep[lo : lo + 4096] = both >= np.minimum(least, -(-percent * np.maximum(n[x], n[y]) // 100))
    i, j = i[keep], j[keep]
    return pa.table([node[i], node[j], n[i], n[j], component[i], component[j]], names=["a", "b", "a_n", "b_n", "a_component", "b_component"])


def _likely_lists(several: DataFrame, classes: DataFrame, k: int, percent: int, least: int) -> DataFrame:
    """Stored (list, node, n, component, lo), as of `several`, by rare retained values instead of runs.

    A value of more than `SHORT` documents is a list; of the others each pair that may link is one.
    """
    members = several.select("node", "component", "n").distinct().join(classes.select("node", "sketch"), "node")
    members = ex.materialise(members, "candidates")
    grades, bits = _grades(members, k)
    about = functools.partial(_rarest, k=k, percent=percent, least=least, grades=grades, bits=bits)
    rare = ex.materialise(members.mapInArrow(about, "list long, node long, n long, component long"), "rare")
    values = rare.groupBy("list").agg(F.min("component").alias("least"), F.max("component").alias("last"), F.count(F.lit(1)).alias("m")).where("least < last")
    values = ex.materialise(values.select("list", "least", "m"), "values")
    near = ex.materialise(_of_several(rare, values, heaviest(values, "m")), "near")
    ex.discard(rare)
    light = near.where("m is null").drop("least", "m").join(values, "list")
    shared_ = ex.materialise(light.unionByName(near.where("m is not null")), "shared")
    for table in (near, values):
        ex.discard(table)
    short = shared_.where(F.col("m") <= SHORT).drop("least", "m")
    bins = max(1, math.ceil(short.count() / BIN))
    marks = members.select("node", "sketch").mapInArrow(_marks, "node long, marks binary")
    binned = short.join(marks, "node").withColumn("bin", F.pmod(F.xxhash64("list"), F.lit(bins)))
    pairs = ex.materialise(binned.groupBy("bin").applyInArrow(ex.one(_near_pairs, k=k, percent=percent, least=least), schema=_PAIR).distinct(), "near_pairs")
    sides = [pairs.select(F.xxhash64("a", "b").alias("list"), F.col(e).alias("node"), F.col(f"{e}_n").alias("n"), F.col(f"{e}_component").alias("component"), F.least("a_component", "b_component").alias("lo")) for e in "ab"]
    long_ = shared_.where(F.col("m") > SHORT).select("list", "node", "n", "component", F.col("least").alias("lo"))
    out = ex.materialise(sides[0].unionByName(sides[1]).unionByName(long_), "likely_lists")
    for table in (members, shared_, pairs):
        ex.discard(table)
    return out


def _cross_links(lists: DataFrame, classes: DataFrame, sets: DataFrame, k: int, percent: int, least: int) -> DataFrame | None:
    """Stored links between components that lists hold together; none if no list does.

    `lists` is a stored table of (list, node, n, hot, component), of lists with more than two
    documents, as those of two are decided already; fewer than `skew.HEAVY` lists are hot.  Many documents share a run of common values by
    chance, so `_likely_lists` takes the place of these lists.  Tiles meet if they share one of
    its lists and their sizes are near, so that no row is made for a pair of copies; full sets
    follow only where sketches have likely partners.
    """
    mixed = lists.groupBy("list", "hot").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    mixed = ex.materialise(mixed.select("list", "hot", "lo"), "mixed")
    light = lists.where("not hot").join(mixed.where("not hot").select("list", "lo"), "list")
    hot = lists.where("hot").join(F.broadcast(mixed.where("hot").select("list", "lo")), "list")
    several = ex.materialise(light.unionByName(hot).drop("hot"), "several")
    ex.discard(mixed)
    if several.isEmpty():
        return None
    found = _likely_lists(several, classes, k, percent, least)
    ex.discard(several)
    several = found
    if several.isEmpty():
        return None
    places = _tiles(several, percent)
    small = places.where("single").agg(F.count(F.lit(1)).alias("m"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    bins = max(1, math.ceil(small["m"] / TILE), math.ceil(small["n"] / LOAD))
    of_node = several.groupBy("node").agg(F.collect_list("list").alias("lists"))
    placed = of_node.join(places.where("not single").select("node", "tile", "step"), "node")
    of_tile = placed.groupBy("tile", "step").agg(F.array_distinct(F.flatten(F.collect_list("lists"))).alias("lists"))
    spots = ex.materialise(of_tile.select(F.explode("lists").alias("list"), "tile", "step"), "spots")
    one_, two_ = (spots.select("list", F.col("tile").alias(f"t{i}"), F.col("step").alias(f"s{i}")) for i in (1, 2))
    pure = places.where("pure").select("tile").distinct()
    pairs = one_.join(two_, "list").where("t1 <= t2 and abs(s1 - s2) <= 1").select("t1", "t2").distinct()
    pairs = ex.materialise(pairs.join(pure.select(F.col("tile").alias("t1"), F.col("tile").alias("t2")), ["t1", "t2"], "left_anti"), "pairs")
    same = F.col("t1") == F.col("t2")
    roles = pairs.select(F.col("t1").alias("tile"), "t1", "t2", F.when(same, 0).otherwise(1).alias("side")).unionByName(pairs.where(~same).select(F.col("t2").alias("tile"), "t1", "t2", F.lit(2).alias("side")))
    about = ["family", "node", "n", "component"]
    marks = classes.select("node", "sketch").mapInArrow(_marks, "node long, marks binary")
    asked = roles.join(places.select("tile", *about), "tile").drop("tile").join(marks, "node")
    likely = ex.materialise(asked.groupBy("t1", "t2").applyInArrow(ex.one(_likely, percent=percent, least=least), schema="t1 string, t2 string, node long, side int"), "likely")
    binned = F.pmod(F.xxhash64("family"), F.lit(bins)).cast("string")
    rows = places.where("single").select(binned.alias("t1"), binned.alias("t2"), "node", F.lit(0).alias("side")).unionByName(likely)
    shipped = rows.join(places.select(*about), "node").join(classes.select("node", "sketch"), "node").join(sets.select("node", "grams"), "node")
    return ex.materialise(shipped.groupBy("t1", "t2").applyInArrow(ex.one(_meet, k=k, percent=percent, least=least), schema="a long, b long"), "links")


def _marks(batches):
    """Four bytes of each retained value."""
    for batch in batches:
        short = [np.frombuffer(x, dtype=np.uint64).astype(np.uint32).tobytes() for x in batch.column("sketch").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(short, pa.binary())], names=["node", "marks"])


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, sketch: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs.

    Two documents link when ``100 * |A ∩ B| >= percent * |A ∪ B|`` for their sets of
    distinct ``n``-word shingles.  ``component_id`` is the smallest id that links reach;
    ``kept`` says that the row's own id is that one (or that both are null).
    """
    if not 50 <= percent < 100:
        raise ValueError("percent must be at least 50 and below 100")
    most, least = longest_run(percent, sketch), least_common(percent, sketch)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    described = ex.materialise(texts.mapInArrow(functools.partial(_describe, n=n, k=sketch), "doc_id long, th long, n_shingles long, sig binary, sketch binary"), "sketches")
    named = described.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min(F.struct("doc_id", "th", F.col("n_shingles").alias("n"), "sketch")).alias("r"))
    classes = ex.materialise(named.select("sig", "r.*").withColumn("node", F.monotonically_increasing_id()), "classes")
    rows = ex.materialise(described.select("doc_id", "n_shingles", "sig"), "rows")
    ex.discard(described)

    keys = classes.select("node", "n", "sketch").mapInArrow(functools.partial(_list_keys, k=sketch, percent=percent, most=most), "list long, node long, n long")
    postings = ex.materialise(keys, "postings")
    several = postings.groupBy("list").agg(F.min("node").alias("least"), F.max("node").alias("last"), F.count(F.lit(1)).alias("m")).where("least < last")
    firsts = ex.materialise(several.select("list", "least", "m"), "firsts")
    near = ex.materialise(_of_several(postings, firsts, heaviest(firsts, "m")), "near")
    ex.discard(postings)
    light = near.where("m is null").select("list", "node", "n").join(firsts, "list").withColumn("hot", F.lit(False))
    lists = ex.materialise(light.unionByName(near.where("m is not null").withColumn("hot", F.lit(True))), "lists")
    for table in (near, firsts):
        ex.discard(table)

    wanted = lists.select("node").distinct().join(classes.select("node", "doc_id", "th", "n"), "node")
    wanted = ex.materialise(wanted.withColumn("h", F.xxhash64("doc_id", "th")), "wanted")
    found = texts.withColumn("h", F.xxhash64("doc_id", "th")).where("doc_id is not null").mapInArrow(functools.partial(_full_sets, n=n, flags=bitmap.build(wanted)), "doc_id long, th long, grams binary")
    sets = ex.materialise(found.groupBy("doc_id", "th").agg(F.first("grams").alias("grams")).join(wanted, ["doc_id", "th"]).select("node", "n", "grams"), "sets")

    star = lists.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    edges = _verified(_pair_sketches(star, classes, sketch, percent, least, "star"), sets, percent)
    labelled = ex.materialise(_labelled(lists.where("m > 2").select("list", "node", "n", "hot"), edges, "node", "component"), "labelled")
    ex.discard(lists)
    more = _cross_links(labelled, classes, sets, sketch, percent, least)
    if more is not None:
        edges = edges.unionByName(more)
    for table in (labelled, wanted, sets):
        ex.discard(table)

    reach = ex.materialise(_labelled(classes.select("sig", "doc_id", "node"), edges, "node", "component"), "reach")
    smallest = reach.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    reach = ex.materialise(lookup(reach, smallest, ["component"], "inner", heavy_keys(reach, ["component"])).select("sig", "component_id"), "reach")
    out = lookup(rows, reach, ["sig"], "left", heavy_keys(rows, ["sig"]))
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
