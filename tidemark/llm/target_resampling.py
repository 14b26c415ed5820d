"""Importance resampling of documents toward a target, by hashed word runs.

Every document becomes a packed stream of uint16 buckets, one for each run of up to three
words; streams of about a megabyte of text lie in one row with the bounds of their
documents.  Counts of the whole corpus come from streams that are sorted and run-length
encoded one by one and added up in an array of one entry a bucket, so a task holds one
stream and 10,000 counts, whatever the corpus.  The gains of the buckets (10,000 numbers)
go back to the streams, where they are gathered and summed by document.  The draw is that
of Gumbel's trick: the highest noisy weights, ranked by ranges of the score that Spark
learns from the data.

Defined results: null and empty texts have no features and weigh 0; rows that repeat are
weighed and ranked each for itself; a null ``doc_id`` takes its noise from the empty id and
comes last among equal scores; with an empty target, or an empty table, all still holds
(gains follow from the counts 0); other columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crc
from .arrays import NON_ALNUM, slices, words_of
from .exchange import discard, materialise

STREAMS = "ids array<bigint>, words array<bigint>, bounds binary, stream binary"


def _stream(batches, runs: int, buckets: int):
    """Bucket streams of documents, in order, with the place where each one ends."""
    for table in (part for batch in batches for part in slices(batch)):
        words = words_of(table.column("text"), NON_ALNUM, lower=True)
        length = words.end - words.start
        one = crc.ranges(words.data, words.start, words.end)
        # of the words with the space before them
        spaced = crc.joined(np.uint32(0xE96CCF45), one, length)
        found = np.zeros((len(one), runs), dtype=np.uint16)
        inside = np.zeros((len(one), runs), dtype=bool)
        so_far = one
        for k in range(runs):
            if k:
                so_far = crc.joined(so_far[:-1], spaced[k:], length[k:] + 1) if len(so_far) else so_far
            found[: len(so_far), k] = so_far % np.uint32(buckets)
            inside[: len(so_far), k] = words.doc[: len(so_far)] == words.doc[k:]
        count = np.diff(words.first)
        features = sum(np.maximum(count - k, 0) for k in range(runs))
        yield pa.RecordBatch.from_pydict(
            {
                "ids": [table.column("doc_id").to_pylist()],
                "words": [count.tolist()],
                "bounds": [np.cumsum(features).astype("<i8").tobytes()],
                "stream": [found[inside].astype("<u2").tobytes()],
            },
            schema=pa.schema([("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("bounds", pa.binary()), ("stream", pa.binary())]),
        )


def bucket_streams(docs: DataFrame, runs: int = 3, buckets: int = 10_000) -> DataFrame:
    """Packed streams of all documents, stored in the shared folder."""
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("a bucket has to fit 16 bits")
    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(functools.partial(_stream, runs=runs, buckets=buckets), STREAMS), "streams")


def _counted(batches, buckets: int):
    total = np.zeros(buckets, dtype=np.int64)
    for batch in batches:
        for raw in batch.column("stream").to_pylist():
            ordered = np.sort(np.frombuffer(raw, dtype="<u2"))
            starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, dtype=np.int64)
            total[ordered[starts]] += np.diff(np.append(starts, len(ordered)))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])


def bucket_counts(streams: DataFrame, buckets: int = 10_000) -> list[int]:
    """How often each bucket occurs; one row a bucket comes to the driver."""
    counted = streams.select("stream").mapInArrow(functools.partial(_counted, buckets=buckets), "bucket int, n long")
    out = [0] * buckets
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of both smoothed distributions, by bucket."""
    size, s_all, t_all = len(source), float(sum(source)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(source, target, strict=True)]


def _gathered(batches, gain: np.ndarray):
    for batch in batches:
        for i in range(batch.num_rows):
            stream = np.frombuffer(batch.column("stream")[i].as_py(), dtype="<u2")
            ends = np.frombuffer(batch.column("bounds")[i].as_py(), dtype="<i8")
            starts = np.concatenate([[0], ends[:-1]])
            weight = np.zeros(len(ends), dtype=np.int64)
            full = ends > starts  # reduceat would give an empty document its neighbour's gain
            if full.any():
                weight[full] = np.add.reduceat(gain[stream], starts[full])
            yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("words")[i].values, pa.array(ends - starts), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])


def weighted(docs: DataFrame, target: DataFrame, runs: int = 3, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row of docs."""
    streams = bucket_streams(docs, runs, buckets)
    wanted = bucket_streams(target.select(F.lit(0).alias("doc_id"), "text"), runs, buckets)
    gain = np.array(gains(bucket_counts(streams, buckets), bucket_counts(wanted, buckets)), dtype=np.int64)
    discard(wanted)
    rows = streams.mapInArrow(functools.partial(_gathered, gain=gain), "doc_id long, n_words long, n_features long, weight long")
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    noise = F.floor(-1000 * F.log(-F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, runs: int = 3, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words), one row for each row of docs.

    Of the rows with at least `least_words` words, `percent` in a hundred are drawn: those
    with the highest scores, ties to the smaller id.  Others have a null rank.
    """
    if not 0 < percent < 100:
        raise ValueError("percent must be within 0 and 100")
    # `share` orders rows that repeat, so that ranges can split them
    rows = materialise(weighted(docs, target, runs, buckets, seed).withColumn("share", F.monotonically_increasing_id()), "scored")
    fit = F.col("n_words") >= least_words
    # within a thousandth of all ranks, so everything that is drawn lies at or above
    near = rows.where(fit).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("score", max(0.0, 0.99 - percent / 100), 1000).alias("low")).first()
    drawn = percent * near["n"] // 100
    fields = ["doc_id", "n_features", "weight", "score"]
    if not drawn:
        return rows.select(*fields, F.lit(None).cast("long").alias("rank"), "n_words")
    top = fit & (F.col("score") >= F.lit(near["low"]))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "share"]
    ordered = rows.where(top).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ordered = materialise(ordered.withColumns({"part": F.shiftright("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)}), "ordered")
    # one row for each shuffle partition
    sizes = sorted((r["part"], r["n"]) for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    placed = ordered.join(F.broadcast(rows.sparkSession.createDataFrame(starts, "part long, before long")), "part")
    rank = F.col("before") + F.col("at") + 1
    ranked = placed.select(*fields, F.when(rank <= drawn, rank).alias("rank"), "n_words")
    return ranked.unionByName(rows.where(~F.coalesce(top, F.lit(False))).select(*fields, F.lit(None).cast("long").alias("rank"), "n_words"))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The documents whose id is drawn, all columns kept; rows of one id go together."""
    ids = resample(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs["doc_id"] == F.col("_drawn"), "left_semi")
