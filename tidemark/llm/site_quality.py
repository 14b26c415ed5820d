"""Quality classifier with site priors, by hierarchical empirical Bayes.

Two heads, low quality and toxic, each give a document's evidence: the summed ridge
logistic weights of its features (hashed words, word beginnings and binned style
measures) that differ between the labelled classes beyond chance.  The chance of each head
is then averaged over all documents by (host, path) and by host through grouped sums, and
shrunk: a path toward its host, a host toward the whole corpus, each as if it had seen so
many more documents of the level above as the data say.  That strength is the variance
of chances within paths over the variance of rates between them, beyond what the former
explains, and is estimated by moments for each head and level.  Evidence and the logit of
the shrunk path rate add up to the posterior that decides.

In `documents`, the host is ``source`` and the path level is ``lang``.  Only the model is
fitted on a bounded sample: the `sample` labelled ids with the smallest hashes.  Rows of a
site with a large share of all meet its rates in a bounded broadcast, others join by site.

Defined results: null and empty texts have the evidence of their style bins alone;
null hosts and paths form a site of their own, apart from empty names; labels that repeat
count once, as the worst; with no usable labels everything is kept; rows that repeat are
judged alike; ties of the posterior at one half are kept; empty tables give no rows;
other columns are ignored, or kept by `keep_good`.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Words, mix, slices, unique_sorted, words_of
from .exchange import materialise
from .sampling import smallest
from .skew import heavy_keys, lookup

SAMPLE = 20_000
CELLS = 1 << 18
STRENGTHS = (1.0, 1e6)  # the least and the most that shrinking may count as
CLIP = 12.0
Z_LEAST, SEEN_LEAST = 6.0, 8
_LETTER = np.zeros(256, dtype=np.uint8)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_UPPER = np.zeros(256, dtype=np.uint8)
_UPPER[65:91] = 1
_SYMBOL = np.zeros(256, dtype=np.uint8)
_SYMBOL[[*range(33, 39), *range(42, 44), 47, *range(60, 65), *range(91, 97), *range(123, 127)]] = 1
_NOT_LETTER = _LETTER == 0


def _by_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _features(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature cells of every document: document number, cell."""
    plain: Words = words_of(table.column("text"))
    letters: Words = words_of(table.column("text"), _NOT_LETTER, lower=True)
    docs = plain.n_docs
    n_bytes = np.maximum(np.diff(plain.text_start), 1)
    n_words = np.maximum(np.diff(plain.first), 1)
    symbols = _by_doc(_SYMBOL[plain.data], plain.text_start) / n_bytes
    upper = _by_doc(_UPPER[plain.data], plain.text_start) / np.maximum(_by_doc(_LETTER[plain.data], plain.text_start), 1)
    h = plain.hashes
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (plain.doc[1:] == plain.doc[:-1])
    repeats = _by_doc(again, plain.first) / n_words
    order = np.lexsort((h, plain.doc))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (plain.doc[order][1:] != plain.doc[order][:-1])
    variety = _by_doc(new, plain.first) / n_words
    single = _by_doc((plain.end - plain.start) == 1, plain.first) / n_words
    style = [np.minimum((m * k).astype(np.int64), 15) for m, k in ((symbols, 40), (upper, 15), (repeats, 20), (variety, 15), (single, 20))]
    style.append(np.minimum(np.log2(n_words).astype(np.int64), 15))
    cells = [np.uint64(i * 16) + s.astype(np.uint64) for i, s in enumerate(style)]
    doc = [np.arange(docs)] * len(cells)
    if len(letters.start):
        clipped = Words(letters.data, letters.start, np.minimum(letters.end, letters.start + 5), letters.first, letters.text_start)
        for salt, words in ((1, letters), (2, clipped)):
            cells.append(np.uint64(256) + mix(words.hashes + np.uint64(salt)) % np.uint64(CELLS - 256))
            doc.append(letters.doc)
    pair = unique_sorted((np.concatenate(doc).astype(np.uint64) << np.uint64(20)) | np.concatenate(cells))
    return (pair >> np.uint64(20)).astype(np.int64), (pair & np.uint64((1 << 20) - 1)).astype(np.int64)


_CELLS_DDL = "cell int, low long, toxic long, clean long"
_LISTS_DDL = "quality int, toxic int, cells binary"


def _cell_counts(batches):
    total = np.zeros((3, CELLS), dtype=np.int64)
    for batch in batches:
        raw = batch.column("cells").to_pylist()
        cell = np.frombuffer(b"".join(raw), dtype=np.int32)
        doc = np.repeat(np.arange(len(raw)), [len(r) // 4 for r in raw])
        quality = batch.column("quality").to_numpy(zero_copy_only=False)
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for i, kind in enumerate((quality == 0, toxic == 1, (quality != 0) & (toxic != 1))):
            total[i] += np.bincount(cell[kind[doc]], minlength=CELLS)
            if kind.any():
                total[i, 255] += int(kind.sum())  # documents of the class
    at = np.flatnonzero(total.any(axis=0))
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(t[at]) for t in total)], names=["cell", "low", "toxic", "clean"])


def _chosen_cells(batches, cells):
    """Of every sampled document, the selected cells."""
    for batch in batches:
        raw = [np.frombuffer(r, dtype=np.int32) for r in batch.column("cells").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("toxic"), pa.array([r[cells.value[r]].tobytes() for r in raw], pa.binary())], names=["quality", "toxic", "cells"])


def _cell_lists(batches):
    """For training: the cells of every sampled document."""
    for table in (part for batch in batches for part in slices(batch)):
        doc, cell = _features(table)
        cell = cell.astype(np.int32)
        bounds = np.searchsorted(doc, np.arange(table.num_rows + 1))
        raw = [cell[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([table.column("quality").combine_chunks(), table.column("toxic").combine_chunks(), pa.array(raw, pa.binary())], names=["quality", "toxic", "cells"])


def _logistic(column: np.ndarray, doc: np.ndarray, y: np.ndarray, width: int, rounds: int = 150, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on binary features, by accelerated gradient steps scaled per feature."""
    n, full = len(y), width
    used, column = np.unique(column, return_inverse=True)
    column, width = column.ravel(), len(used)
    p = min(max(y.mean(), 1e-4), 1 - 1e-4)
    weight, bias = np.zeros(width), float(np.log(p / (1 - p)))
    seen = np.bincount(column, minlength=width)
    per_doc = max(1.0, np.bincount(doc, minlength=n).max(initial=1))
    step = 1.0 / (0.25 * np.sqrt(seen * per_doc * max(seen.max(initial=1), 1)) + penalty)
    ahead, ahead_bias, momentum = weight.copy(), bias, 1.0
    for _ in range(rounds):
        z = np.bincount(doc, ahead[column], n) + ahead_bias
        error = y - 1 / (1 + np.exp(-z))
        new = ahead + step * (np.bincount(column, error[doc], width) - penalty * ahead)
        new_bias = ahead_bias + error.sum() / (0.25 * n * 4)
        follow = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, ahead_bias = new + (momentum - 1) / follow * (new - weight), new_bias + (momentum - 1) / follow * (new_bias - bias)
        weight, bias, momentum = new, new_bias, follow
    out = np.zeros(full)
    out[used] = weight
    return out, bias


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Log ratios of each cell for the two heads; in the last rows their offsets and prior logits.

    Cells that differ between the classes beyond chance are found by grouped counts;
    a ridge logistic regression on them weighs those that come together.
    """
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = smallest(known, sample, "doc_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `sample` short rows at most
    # of the rows of one id one counts, so that the sample is one of rows as well
    rows = rows.groupBy("doc_id", "quality", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("r")).select("r.text", "quality", "toxic")
    rows = materialise(rows.select("text", "quality", "toxic").mapInArrow(_cell_lists, _LISTS_DDL), "sampled")
    counts = materialise(rows.mapInArrow(_cell_counts, _CELLS_DDL).groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("low", "toxic", "clean"))), "cells")
    total = counts.where("cell = 255").first()
    weights = np.zeros((CELLS + 2, 2))
    weights[CELLS + 1] = -CLIP
    if total is None or not total["clean"]:
        return weights
    telling = F.lit(False)
    for head in ("low", "toxic"):
        if total[head]:
            share = total[head] / (total[head] + total["clean"])
            seen = F.col(head) + F.col("clean")
            z = (F.col(head) - seen * share) / F.sqrt(seen * share * (1 - share))
            telling = telling | ((seen >= SEEN_LEAST) & (F.abs(z) >= Z_LEAST))
    cells = np.zeros(CELLS, dtype=bool)
    cells[[r["cell"] for r in counts.where((F.col("cell") != 255) & telling).select("cell").collect()]] = True
    cells[:255] = True
    shared = docs.sparkSession.sparkContext.broadcast(cells)
    got = rows.mapInArrow(functools.partial(_chosen_cells, cells=shared), _LISTS_DDL).collect()  # of the bounded sample
    column = np.frombuffer(b"".join(r["cells"] for r in got), dtype=np.int32)
    doc = np.repeat(np.arange(len(got)), [len(r["cells"]) // 4 for r in got])
    for k, y in enumerate((np.array([r["quality"] == 0 for r in got], float), np.array([r["toxic"] == 1 for r in got], float))):
        if 0 < y.sum() < len(y):
            weights[:CELLS, k], bias = _logistic(column, doc, y, CELLS)
            prior = np.log(y.sum() / (len(y) - y.sum()))
            weights[CELLS, k], weights[CELLS + 1, k] = bias - prior, prior
    return weights


def _evidence(batches, weights, columns: list[str]):
    for table in (part for batch in batches for part in slices(batch)):
        doc, cell = _features(table)
        for k, name in enumerate(("low_evidence", "toxic_evidence")):
            value = np.clip(np.bincount(doc, weights.value[cell, k], table.num_rows) + weights.value[CELLS, k], -CLIP, CLIP)
            table = table.append_column(name, pa.array(value))
        yield from table.select([*columns, "low_evidence", "toxic_evidence"]).to_batches()


def evidence(docs: DataFrame, weights: np.ndarray, columns: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # of CELLS rows
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(functools.partial(_evidence, weights=shared, columns=columns), f"{ddl}, low_evidence double, toxic_evidence double")


HEADS = ("low", "toxic")
_KEYS = ["host_key", "path_key"]


def strengths(paths: DataFrame) -> dict[str, tuple[float, float]]:
    """By head: how many documents of the level above a host and a path count besides their own.

    From rows (host_key, path_key, n, and per head the sum and the sum of squares of
    chances): the variance within paths over that between paths of a host, and between
    hosts, by the usual moments of a one-way layout with unequal sizes.
    """
    hosts = paths.groupBy("host_key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), *(F.sum(c).alias(c) for h in HEADS for c in (h, f"{h}_sq")), *(F.sum(F.col(h) * F.col(h) / F.col("n")).alias(f"{h}_paths") for h in HEADS))
    row = hosts.agg(
        F.sum("n").alias("n"),
        F.sum("k").alias("paths"),
        F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("nn") / F.col("n")).alias("path_nn"),
        F.sum(F.col("n") * F.col("n")).alias("host_nn"),
        *(F.sum(c).alias(c) for h in HEADS for c in (h, f"{h}_sq", f"{h}_paths")),
        *(F.sum(F.col(h) * F.col(h) / F.col("n")).alias(f"{h}_hosts") for h in HEADS),
    ).first()
    if not row["n"]:
        return {h: (STRENGTHS[1], STRENGTHS[1]) for h in HEADS}
    n, low, high = row["n"], *STRENGTHS

    def ratio(within: float, between: float, groups: int, spread: float) -> float:
        """within / tau**2, where tau**2 is the variance between the groups."""
        tau = (between - groups * within) / spread if spread > 0 else 0.0
        return min(max(within / tau, low), high) if tau > 0 else high

    out = {}
    for h in HEADS:
        within = max(row[f"{h}_sq"] - row[f"{h}_paths"], 0.0) / max(n - row["paths"], 1)
        path = ratio(within, row[f"{h}_paths"] - row[f"{h}_hosts"], row["paths"] - row["hosts"], n - row["path_nn"])
        host = ratio(within, row[f"{h}_hosts"] - row[h] * row[h] / n, row["hosts"] - 1, n - row["host_nn"] / n)
        out[h] = (host, path)
    return out


def site_rates(rows: DataFrame, prior: tuple[float, float]) -> DataFrame:
    """Shrunk rate of both heads for every (host_key, path_key), of rows (these, *_evidence)."""
    p = {h: 1 / (1 + F.exp(-(F.col(f"{h}_evidence") + F.lit(float(b))))) for h, b in zip(HEADS, prior, strict=True)}
    sums = [f for h, x in p.items() for f in (F.sum(x).alias(h), F.sum(x * x).alias(f"{h}_sq"))]
    paths = materialise(rows.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"), *sums), "paths")
    strong = strengths(paths)
    hosts = paths.groupBy("host_key").agg(F.sum("n").alias("host_n"), *(F.sum(h).alias(f"host_{h}") for h in HEADS))
    whole = paths.agg(F.sum("n").alias("n"), *(F.sum(h).alias(h) for h in HEADS)).first()
    n = whole["n"] or 1
    shrunk = lambda total, size, s, above: (total + F.lit(s) * above) / (size + F.lit(s))
    hosts = hosts.select("host_key", *(shrunk(F.col(f"host_{h}"), F.col("host_n"), strong[h][0], F.lit((whole[h] or 0.0) / n)).alias(f"host_{h}_rate") for h in HEADS))
    rates = lookup(paths, hosts, ["host_key"], "inner", heavy_keys(paths, ["host_key"]))
    rates = rates.select(*_KEYS, *(f"host_{h}_rate" for h in HEADS), *(shrunk(F.col(h), F.col("n"), strong[h][1], F.col(f"host_{h}_rate")).alias(f"path_{h}_rate") for h in HEADS))
    return materialise(rates, "sites")


def _keyed(docs: DataFrame, host: str, path: str) -> DataFrame:
    return docs.select("*", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(k) for c, k in zip((host, path), _KEYS, strict=True)))


def _posterior(out: DataFrame) -> DataFrame:
    """Adds the chance of each head and the decision to rows with evidence and site rates."""
    for h in HEADS:
        rate = F.least(F.greatest(F.col(f"path_{h}_rate"), F.lit(1e-4)), F.lit(1 - 1e-4))
        out = out.withColumn(f"p_{h}", 1 / (1 + F.exp(-(F.col(f"{h}_evidence") + F.log(rate / (1 - rate))))))
    return out.withColumn("p_good", (1 - F.col("p_low")) * (1 - F.col("p_toxic"))).withColumn("kept", F.col("p_good") >= 0.5)


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, host, path, evidence, site rates, p_low, p_toxic, p_good, kept) of every row of docs."""
    weights = fit(docs, labels, sample)
    rows = materialise(evidence(_keyed(docs.select("doc_id", "text", F.col(host).alias("host"), F.col(path).alias("path")), "host", "path"), weights, ["doc_id", *_KEYS]), "evidence")
    sites = site_rates(rows, tuple(weights[CELLS + 1]))
    out = _posterior(lookup(rows, sites, _KEYS, "inner", heavy_keys(rows, _KEYS)))
    named = [F.when(F.col(k) != "", F.substr(k, F.lit(2))).alias(c) for c, k in zip(("host", "path"), _KEYS, strict=True)]
    return out.select("doc_id", *named, *(c for c in out.columns if c not in ("doc_id", *_KEYS)))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Rows of `docs` that the classifier keeps, with its columns.

    Evidence is computed a second time for the decision, as storing whole texts with it
    would hold a copy of the input on disk.  `docs` is a stored table.
    """
    clash = {*_KEYS, *(f"{h}_evidence" for h in HEADS), "p_good", "kept", *(f"p_{h}" for h in HEADS), *(f"{a}_{h}_rate" for h in HEADS for a in ("host", "path"))} & set(docs.columns)
    if clash:  # names of ours are put aside
        aside = {c: f"{c}_{uuid.uuid4().hex}" for c in clash}
        host, path = aside.get(host, host), aside.get(path, path)
        return keep_good(docs.withColumnsRenamed(aside), labels, host, path, sample).withColumnsRenamed({v: k for k, v in aside.items()})
    weights, keyed = fit(docs, labels, sample), _keyed(docs, host, path)
    narrow = materialise(evidence(keyed, weights, _KEYS), "evidence")
    sites = site_rates(narrow, tuple(weights[CELLS + 1])).select(*_KEYS, *(f"path_{h}_rate" for h in HEADS))
    rated = lookup(keyed, sites, _KEYS, "inner", heavy_keys(narrow, _KEYS))
    rows = evidence(rated, weights, [*docs.columns, *(f"path_{h}_rate" for h in HEADS)])
    return _posterior(rows).where("kept").select(*docs.columns)
