"""Benchmark decontamination with a positional inverted index, split by documents.

Every shard of the index covers about a megabyte of whole texts and holds, for every
term, the sorted list of its positions.  A test window is looked up from its rarest term
in the shard: the positions of that term, less its place in the window, are the possible
starts, and the lists of the other terms, rarest first, are intersected with them after
the same adjustment.  Exact phrases have every term at its place.  With slack, a phrase is
near if its first term is at the start and each other one within `slack` words of its
place, in the same document; what is near does not depend on how texts fall into shards.

Test items go through in blocks of bounded size.  `find` stores the index once and looks
each block up in a job of its own (the first one as the index is made), which writes its
matches only; they are put together by document in the end.  `mark` keeps rows in place: it tokenises and searches its own
texts for each block in turn, and stores them between two blocks.  So a task holds one
block at a time, and the corpus is never shuffled.

Defined results: null and empty texts and items have no words; an item of fewer
words than the window, but not none, is one window; items or documents that repeat
count each for themselves (``n_items`` counts distinct ids); a null ``item_id``
hits words but is in no list; no benchmark rows: nothing is hit; empty documents: no
rows; other columns, whatever their names, are kept by `mark` and ignored by `find`.
"""

from __future__ import annotations

import functools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import NON_ALNUM, release, slices, spread, within_docs, words_of
from .exchange import materialise

WINDOW = 10
BLOCK_BYTES = 4_000_000  # of test items that one pass over the index looks for
_CHUNK = 500_000  # possible starts held at a time


class Tests:
    """Distinct windows of a block of test items."""

    def __init__(self, ids: list, texts: list, window: int) -> None:
        words = words_of(pa.array(texts, pa.string()), NON_ALNUM, lower=True)
        self.terms = np.unique(words.hashes)
        term = np.searchsorted(self.terms, words.hashes).astype(np.int64)
        rows: dict[tuple, set] = {}
        for i, item in enumerate(ids):
            own = term[words.first[i] : words.first[i + 1]].tolist()
            for k in range(max(1, len(own) - window + 1) if own else 0):
                rows.setdefault(tuple(own[k : k + window]), set()).add(item)
        self.size = np.array([len(r) for r in rows], dtype=np.int64)
        self.term = np.full((len(rows), window), -1, dtype=np.int64)
        for i, r in enumerate(rows):
            self.term[i, : len(r)] = r
        items = [sorted((str(x) for x in s if x is not None)) for s in rows.values()]
        self.item = np.array([x for s in items for x in s], dtype=object)
        self.item_first = np.cumsum([0, *(len(s) for s in items)])


def _postings(table: pa.Table) -> dict:
    """One shard: positions of each term in the texts laid end to end."""
    words = words_of(table.column("text"), NON_ALNUM, lower=True)
    order = np.argsort(words.hashes, kind="stable")
    ordered = words.hashes[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, dtype=np.int64)
    return {"first": words.first, "term": ordered[heads], "count": np.diff(np.append(heads, len(ordered))), "position": order.astype(np.uint32)}


def _matches(shard: dict, tests: Tests, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, exact) of every match within the slack."""
    first, n = shard["first"], len(tests.size)
    total = int(first[-1])
    where = np.searchsorted(tests.terms, shard["term"])
    tested = where < len(tests.terms)
    tested[tested] = tests.terms[where[tested]] == shard["term"][tested]
    count = np.zeros(len(tests.terms) + 1, dtype=np.int64)
    count[where[tested]] = shard["count"][tested]
    begin = np.zeros(len(tests.terms) + 1, dtype=np.int64)
    begin[1:] = np.cumsum(count[:-1])
    position = shard["position"][np.repeat(tested, shard["count"])].astype(np.int64)
    term_of = np.repeat(np.arange(len(count)), count).astype(np.uint64)
    postings = (term_of << np.uint64(32)) | position.astype(np.uint64)
    held = np.where(tests.term >= 0, count[tests.term], np.iinfo(np.int64).max)
    alive = np.flatnonzero((held > 0).all(axis=1)) if n else np.zeros(0, dtype=np.int64)
    rarest = np.argsort(held[alive], axis=1, kind="stable")
    out = []
    wide = 2 * slack + 1
    load = np.cumsum(wide * held[alive, rarest[:, 0]]) if len(alive) else np.zeros(0)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(load, np.arange(_CHUNK, (load[-1] if len(load) else 0) + _CHUNK, _CHUNK), side="left") + 1]).clip(0, len(alive)))
    doc_of = np.searchsorted(first, np.arange(total), side="right") - 1
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        w, by = alive[a:b], rarest[a:b]
        anchor = tests.term[w, by[:, 0]]
        reps = count[anchor]
        row = np.repeat(np.arange(len(w)), reps)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(reps) - reps, reps)
        start = position[begin[anchor][row] + inner] - by[row, 0]
        if slack:  # the rarest term may stand up to `slack` words from its place, the first one not at all
            shift = np.where(by[row, 0] > 0, slack, 0)
            moved = np.arange(-slack, slack + 1)
            start, row = (start[:, None] - moved).ravel(), np.repeat(row, wide)
            ok = np.abs(np.tile(moved, len(shift))) <= np.repeat(shift, wide)
            start, row = start[ok], row[ok]
        last = start + tests.size[w][row] - 1
        ok = (start >= 0) & (last < total)
        row, start, last = row[ok], start[ok], last[ok]
        ok = doc_of[start] == doc_of[last]
        row, start = row[ok], start[ok]
        low, high = first[doc_of[start]], first[doc_of[start] + 1] - 1
        exact = np.ones(len(row), dtype=bool)
        for k in range(by.shape[1]):
            place = by[row, k]
            term = tests.term[w[row], place]
            inside = term >= 0
            want = start + place
            off = np.where(place > 0, slack, 0)
            top = np.where(inside, term, 0).astype(np.uint64) << np.uint64(32)
            hit = np.searchsorted(postings, top | np.maximum(want - off, low).astype(np.uint64))
            near = postings[np.minimum(hit, len(postings) - 1)] if len(postings) else top
            fits = ~inside | ((hit < len(postings)) & (near >> np.uint64(32) == top >> np.uint64(32)) & ((near & np.uint64(0xFFFFFFFF)).astype(np.int64) <= np.minimum(want + off, high)))
            if slack:
                key = top | want.astype(np.uint64)
                hit = np.searchsorted(postings, key)
                exact &= ~inside | ((hit < len(postings)) & (postings[np.minimum(hit, len(postings) - 1)] == key))
            row, start, exact, low, high = (x[fits] for x in (row, start, exact, low, high))
            if not len(row):
                break
        out.append((w[row], start, exact))
    if not out:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, np.zeros(0, dtype=bool)
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3))  # type: ignore[return-value]


def _covered(first: np.ndarray, tests: Tests, window: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which words of a shard lie in the given windows."""
    covered = np.zeros(int(first[-1]), dtype=bool)
    for size in np.unique(tests.size[window]):
        flag = np.zeros(len(covered), dtype=bool)
        flag[start[tests.size[window] == size]] = True
        covered |= spread(flag, int(size))
    return covered


class _Bounds:
    def __init__(self, first: np.ndarray) -> None:
        self.first = first


_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_FOUND = [("pos", pa.int32()), ("ranges", _RANGES), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))]
_FOUND_DDL = "pos: int, ranges: array<struct<start: long, end: long>>, items: array<string>, near: array<string>"
_INDEX = f"shard long, doc_ids array<long>, n_words array<long>, terms binary, counts binary, positions binary, found array<struct<{_FOUND_DDL}>>"
_INDEX_SCHEMA = pa.schema([("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("terms", "counts", "positions")), ("found", pa.list_(pa.struct(_FOUND)))])
_MATCH = f"shard long, found array<struct<{_FOUND_DDL}>>"


def _found(shard: dict, tests: Tests, slack: int) -> list[dict]:
    """Of each document with a match: its place in the shard, hit ranges of words, and ids of exact and near items."""
    first = shard["first"]
    window, start, exact = _matches(shard, tests, slack)
    if not len(window):
        return []
    covered = _covered(first, tests, window[exact], start[exact])
    doc = np.searchsorted(first, start, side="right") - 1
    sets: dict[int, tuple[set, set]] = {}
    for d, w, e in set(zip(doc.tolist(), window.tolist(), exact.tolist(), strict=True)):
        names = tests.item[tests.item_first[w] : tests.item_first[w + 1]]
        own = sets.setdefault(d, (set(), set()))
        own[1].update(names)
        if e:
            own[0].update(names)
    out = []
    for d, (own, near) in sorted(sets.items()):
        edge = np.diff(np.concatenate([[0], covered[first[d] : first[d + 1]].view(np.int8), [0]]))
        ranges = [{"start": a, "end": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
        out.append({"pos": d, "ranges": ranges, "items": sorted(own), "near": sorted(near)})
    return out


def _shards(batches, tests, slack: int):
    """Index rows, one at a time, with what the first block of test items finds in them."""
    shard_id = TaskContext.get().partitionId() << 33
    for table in (part for batch in batches for part in slices(batch)):
        shard = _postings(table)
        row = [shard_id, table.column("doc_id").to_pylist(), np.diff(shard["first"]), shard["term"].astype(np.uint64).tobytes(), shard["count"].astype(np.uint32).tobytes(), shard["position"].tobytes(), _found(shard, tests.value, slack)]
        yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, _INDEX_SCHEMA, strict=True)], schema=_INDEX_SCHEMA)
        shard_id += 1


def _search(batches, tests, slack: int):
    """What a further block of test items finds in index rows."""
    for batch in batches:
        for row in range(batch.num_rows):
            get = lambda c: batch.column(c)[row].as_py()  # noqa: E731, B023
            first = np.concatenate([[0], np.cumsum(np.array(get("n_words"), dtype=np.int64))]).astype(np.int64)
            shard = {"first": first, "term": np.frombuffer(get("terms"), np.uint64), "count": np.frombuffer(get("counts"), np.uint32).astype(np.int64), "position": np.frombuffer(get("positions"), np.uint32)}
            if found := _found(shard, tests.value, slack):
                yield pa.RecordBatch.from_arrays([pa.array([get("shard")], pa.int64()), pa.array([found], _INDEX_SCHEMA.field("found").type)], names=["shard", "found"])
        release()


def _blocks(benchmark: DataFrame, window: int) -> tuple[int, Iterator[Tests]]:
    """Number of bounded blocks of test items, and one after the other."""
    benchmark = benchmark.select("item_id", "text").distinct()  # items that repeat are one
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, math.ceil(size / BLOCK_BYTES))

    def each() -> Iterator[Tests]:
        for k in range(blocks):
            rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
            yield Tests([r["item_id"] for r in rows], [r["text"] for r in rows], window)

    return blocks, each()


def build_index(docs: DataFrame, tests, slack: int) -> DataFrame:
    """Index shards of all whole texts and all their terms, stored in the shared folder; the first block of items is looked up on the way."""
    return materialise(docs.select("doc_id", "text").mapInArrow(functools.partial(_shards, tests=tests, slack=slack), _INDEX), "index")


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = 2) -> DataFrame:
    """(doc_id, n_words, n_hit, items, near_items, ranges), one row for each row of docs.

    ``items`` have an exact window, ``near_items`` one within the slack (exact ones
    included); ``ranges`` are the hit words of a document as half-open ranges of places.
    """
    index, parts = None, []
    for tests in _blocks(benchmark, window)[1]:
        shared = docs.sparkSession.sparkContext.broadcast(tests)  # of one bounded block
        if index is None:
            index = build_index(docs, shared, slack)
            parts.append(index.select("shard", "found"))
        else:
            parts.append(materialise(index.drop("found").mapInArrow(functools.partial(_search, tests=shared, slack=slack), _MATCH), "matches"))
        shared.unpersist()
    found = functools.reduce(DataFrame.unionByName, parts).select("shard", F.inline("found"))
    every = found.groupBy("shard", "pos").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # a row per document and block
    # ranges of several blocks may overlap: those that begin within what is covered only lengthen it
    joined = F.expr("""aggregate(array_sort(ranges), CAST(array() AS array<struct<start: bigint, end: bigint>>), (a, r) -> CASE
        WHEN size(a) > 0 AND r.start <= element_at(a, -1).end
        THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, r.end))))
        ELSE concat(a, array(r)) END)""")
    every = every.withColumn("ranges", joined)
    rows = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("pos", "d")).select("shard", "pos", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").alias("n_words"))
    out = rows.join(every, ["shard", "pos"], "left")
    n_hit = F.aggregate(F.coalesce("ranges", F.array()), F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    empty = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", empty).alias("items"), F.coalesce("near", empty).alias("near_items"), "ranges")


def _mark(batches, tests, bits: str, name: str, last: bool):
    """Rows with the hit words of the blocks so far, as bits; after the last one, with their number."""
    for table in (part for batch in batches for part in slices(batch)):
        shard = _postings(table)
        window, start, _ = _matches(shard, tests.value, 0)
        first = shard["first"]
        covered = _covered(first, tests.value, window, start)
        if bits in table.column_names:
            for d, raw in enumerate(table.column(bits).to_pylist()):
                own = covered[first[d] : first[d + 1]]
                own |= np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=len(own)).astype(bool)
            table = table.drop_columns([bits])
        if last:
            table = table.append_column(name, pa.array(within_docs(covered, _Bounds(first))))
        else:
            table = table.append_column(bits, pa.array([np.packbits(covered[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()))
        yield from table.to_batches()


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with a last column ``n_hit``; each task indexes and searches its own texts, so rows stay in place.

    Columns of docs stay as they are; if one of them has that name, in any case, the last
    one is ``n_hit_1``, or the first such name that is free.
    """
    taken = {c.lower() for c in docs.columns}
    name = next(c for k in range(len(taken) + 1) if (c := f"n_hit_{k}" if k else "n_hit") not in taken)
    blocks, each = _blocks(benchmark, window)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    bits, out = f"bits_{uuid.uuid4().hex}", docs
    for k, tests in enumerate(each):
        shared, last = docs.sparkSession.sparkContext.broadcast(tests), k == blocks - 1
        out = out.mapInArrow(functools.partial(_mark, tests=shared, bits=bits, name=name, last=last), f"{fields}, {f'{name} long' if last else f'{bits} binary'}")
        if not last:
            out = materialise(out, "marked")
            shared.unpersist()
    return out


def digest(found: DataFrame) -> DataFrame:
    """The checksum form of `find`."""
    items = F.array_sort("items")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near_items"))
