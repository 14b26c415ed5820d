"""Language identification by compression with per-language dictionaries.

A language is a zstandard raw-content dictionary of pieces of its texts.  A text,
lower-cased and with everything but letters as single spaces, is compressed in whole
in blocks with each dictionary; the smallest sum wins.  It is accepted only if the
runner-up is larger by a margin, which short or mixed texts do not reach.

Dictionaries are filled from all texts that may be learned from and hold a letter: these
are seen as pieces of `PIECE` characters, wherever in a text they lie, and a language takes
those with the smallest hashes until `dictionary_bytes` are full.  A long text so counts for
as many pieces as it has, and stubs for what they hold.  Only the dictionaries are bounded;
everything else looks at whole texts of all rows.  Languages go through `LANGUAGES` at a
time, so what a task holds does not grow with their number.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties
go to the language that sorts first; rows that repeat are judged each for itself; with
nothing to learn from every text is ``und``; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import release
from .exchange import materialise
from .sampling import SPAN

DICTIONARY_BYTES = 110_000
PIECE = 6_000  # characters
BLOCK = 4_096
LANGUAGES = 100  # whose dictionaries a task holds at a time
_OTHER = re.compile(r"[\W\d_]+")


def normal(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


@functools.lru_cache(maxsize=4)
def _compressors(names: tuple[str, ...], dictionaries: tuple[bytes, ...], level: int):
    import zstandard

    out = []
    for raw in dictionaries:
        known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def sizes(text: str | None, compressors: list) -> list[int] | None:
    """Bytes of a whole text under each dictionary; None for a text without letters."""
    plain = normal(text) if text else ""
    if not any(map(str.isalpha, plain)):
        return None
    raw = f" {plain} ".encode()
    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    return [sum(len(c.compress(b)) for b in blocks) for c in compressors]


def best_two(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The smallest two of (bytes, language), ties by name."""
    return sorted(found)[:2]


def verdict(best: list[tuple[int, str]]) -> tuple[str, float, bool]:
    """Language, score and whether the margin is wide enough, from the smallest two."""
    if not best:
        return "und", 0.0, False
    if len(best) == 1:
        return best[0][1], 1.0, True
    (least, name), (second, _) = best
    margin = second - least
    return name, 1 / (1 + math.exp(-min(margin, 200) / 4)), margin >= max(2, 0.02 * least)


_PASS = "doc_id long, text string, held_out boolean, best array<struct<size: long, name: string>>"
_BEST = pa.list_(pa.struct([("size", pa.int64()), ("name", pa.string())]))
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])


def _predict(batches, names: tuple[str, ...], dictionaries: tuple[bytes, ...], level: int, last: bool):
    """The best two languages so far of each text; after the last block of languages, the verdict."""
    compressors = _compressors(names, dictionaries, level)
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            before = part.column("best").to_pylist() if "best" in part.schema.names else [None] * part.num_rows
            got = []
            for text, old in zip(part.column("text").to_pylist(), before, strict=True):
                found = sizes(text, compressors)
                got.append([] if found is None else best_two([*((x["size"], x["name"]) for x in old or []), *zip(found, names, strict=True)]))
            columns = [part.column("doc_id").cast(pa.int64()), part.column("held_out")]
            if last:
                out = [verdict(b) for b in got]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([g[i] for g in out], _OUT.field(i + 2).type) for i in range(3))], schema=_OUT)
            else:
                best = pa.array([[{"size": s, "name": n} for s, n in b] for b in got], _BEST)
                yield pa.RecordBatch.from_arrays([columns[0], part.column("text"), columns[1], best], names=["doc_id", "text", "held_out", "best"])
        release()


def pieces(labelled: DataFrame, piece: int = PIECE) -> DataFrame:
    """(lang, doc_id, th, text, n): rows to learn from, with a hash of the text and the number of pieces of each."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    return usable.select("lang", "doc_id", F.xxhash64("text").alias("th"), "text", F.ceil(F.length("text") / F.lit(piece)).cast("int").alias("n"))


def languages(rows: DataFrame) -> dict[str, int]:
    """Characters of each language that there is something to learn of."""
    counted = rows.groupBy("lang").agg(F.sum(F.length("text").cast("long")).alias("size")).collect()  # a row per language
    return {r["lang"]: r["size"] for r in counted}


def _taken(rows: DataFrame, bounds: dict[str, int], dictionary_bytes: int, piece: int) -> list:
    """Pieces of the given languages whose hash lies below a language's bound, up to a dictionary of each; equal pieces count once."""
    h = lambda p: F.xxhash64("doc_id", "th", p)
    most = F.coalesce(*(F.when(F.col("lang") == k, F.lit(m - SPAN // 2 - 1)) for k, m in bounds.items()))
    # only the numbers of pieces are listed; text is cut for those that are taken
    own = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda p: h(p) <= F.col("most"))
    cut = rows.where(F.col("lang").isin(list(bounds))).withColumn("most", most).select("lang", "doc_id", "th", "text", F.explode(own).alias("p"))
    cut = cut.select("lang", h(F.col("p")).alias("h"), F.substring("text", F.col("p") * piece + 1, F.lit(piece)).alias("text"))
    cut = cut.groupBy("lang", "h").agg(F.min("text").alias("text"))  # rows that repeat, before their shuffle
    order = Window.partitionBy("lang").orderBy("h")  # some hundred kilobytes of a language
    upto = F.sum(F.octet_length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("upto", upto - F.octet_length("text")).where(F.col("upto") < dictionary_bytes).orderBy("lang", "h").select("lang", "text").collect()


def learn(rows: DataFrame, found: dict[str, int], dictionary_bytes: int = DICTIONARY_BYTES, piece: int = PIECE) -> dict[str, bytes]:
    """Raw-content dictionaries of the given languages, from `pieces`; a language sends at most about four times its dictionary to the order.

    A language that gets less than its dictionary holds is asked for again with a wider
    bound, until it is full or all its pieces were taken: so one that mostly repeats
    itself still has one.
    """
    bounds = {k: min(SPAN, SPAN * 4 * dictionary_bytes // max(n, 1)) for k, n in found.items()}
    out: dict[str, bytes] = {}
    while bounds:
        got = dict.fromkeys(bounds, b"")
        filled = dict.fromkeys(bounds, 0)
        for row in _taken(rows, bounds, dictionary_bytes, piece):
            raw = f" {normal(row['text'])} ".encode()
            filled[row["lang"]] += len(row["text"].encode())
            if raw.strip() and len(got[row["lang"]]) + len(raw) <= dictionary_bytes:
                got[row["lang"]] += raw
        out |= {k: v for k, v in got.items() if v}
        bounds = {k: min(SPAN, 16 * m) for k, m in bounds.items() if m < SPAN and filled[k] < dictionary_bytes}
    return out


def identify(docs: DataFrame, folds: int = 5, level: int = 3) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted); learns where ``crc32(doc_id as text) % folds`` is not 0."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == 0, F.lit(False))
    rows = pieces(docs.select("doc_id", "text", "lang", held.alias("held_out")).where("not held_out and doc_id is not null"))
    found = sorted(languages(rows).items())
    blocks = [dict(found[i : i + LANGUAGES]) for i in range(0, len(found), LANGUAGES)] or [{}]
    out = docs.select("doc_id", "text", held.alias("held_out"))
    for k, block in enumerate(blocks):
        known = learn(rows, block) if block else {}
        names, last = tuple(sorted(known)), k == len(blocks) - 1
        predict = functools.partial(_predict, names=names, dictionaries=tuple(known[n] for n in names), level=level, last=last)
        ddl = "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean" if last else _PASS
        out = out.mapInArrow(predict, ddl)
        if not last:
            out = materialise(out, "languages")
    return out
