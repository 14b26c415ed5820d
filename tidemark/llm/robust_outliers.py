"""Quality rules by robust multivariate outliers, in DataFrame expressions only.

Each document becomes a vector of transformed text statistics.  For every (language,
source), and for all documents, a minimum-covariance-determinant estimate is reached
by concentration steps: start from medians and median absolute deviations, take the
half (`share`) with the smallest distances, re-estimate mean and covariance from it,
and repeat; a last step takes all within the `REWEIGHT` level of the chi-square
distribution.  Covariances are made consistent by the factor that normal data need for
that share, floored in every direction by a fixed measurement scale, and inverted by a
Cholesky factorisation written out as column expressions.  A group's moments are shrunk
toward those of all documents, as if `prior` more documents had these, so that small
groups need no rule of their own.  Documents whose squared Mahalanobis distance exceeds
the chi-square value of chance `level` are rejected.

A step is one aggregation by group and distance bin (a sixteenth of an octave), so that
the closest half is what the first bins hold: no sort, no quantile sketch, and no task
that holds a group.  Estimates of all documents are plain numbers and need no join.
Documents meet their group's estimate by `skew.lookup`, so a source with a third of all
rows is no hot task.

Words are ``[^\\x20\\x09-\\x0D]+``.  Defined results: null and empty texts have no words
and fail the base rule; null languages and sources form groups of their own, apart from
empty names; rows that repeat are judged alike; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .exchange import materialise
from .skew import heavy_keys, lookup

#: Statistics, and the scale below which a spread is noise.
VECTOR = ("symbols", "dup_lines", "repeats", "word_length", "digits")
FLOORS = (0.20, 0.40, 0.40, 0.15, 0.40)
D = len(VECTOR)
LEVEL = 1e-6  # chance that a document of normal statistics is rejected
SHARE = 0.5
REWEIGHT = 0.975
STEPS = 3
PRIOR = 30.0
_PLACE = (1 << 30) - 1


def statistics(docs: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, *columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_digits)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", *columns, text.alias("t"), F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("lines", lines).withColumn("n", F.size("w"))
    rows = rows.withColumn("h", F.expr("transform(slice(w, 1, greatest(n - 2, 0)), (x, i) -> xxhash64(x, w[i + 1], w[i + 2]))"))
    # where windows repeat, part of their hash with the place in the lower bits: plain numbers, which sort fast; equal neighbours may repeat
    places = f"sort_array(transform(h, (x, i) -> (x & {~_PLACE}L) | i))"
    rows = rows.withColumn("p", F.expr(f"IF(size(array_distinct(h)) < size(h), {places}, CAST(array() AS array<bigint>))"))
    rows = rows.withColumn("p", F.expr("filter(p, (x, k) -> (k > 0 AND shiftright(p[k - 1], 30) = shiftright(x, 30)) OR (k + 1 < size(p) AND shiftright(p[k + 1], 30) = shiftright(x, 30)))"))
    # whole hashes decide, of those few
    rows = rows.withColumn("s", F.expr(f"sort_array(transform(transform(p, x -> CAST(x & {_PLACE}L AS INT)), i -> struct(h[i] AS h, i AS i)))"))
    rows = rows.withColumn("r", F.expr("array_sort(filter(s, (x, k) -> (k > 0 AND s[k - 1].h = x.h) OR (k + 1 < size(s) AND s[k + 1].h = x.h)).i)"))
    # words covered by windows of three: each new place adds three, less what the one before covers
    covered = F.expr("aggregate(r, named_struct('end', CAST(-1 AS INT), 'sum', 0L), (a, i) -> named_struct('end', i + 2, 'sum', a.sum + (i + 2 - greatest(a.end, i - 1))), a -> a.sum)")
    return rows.select(
        "doc_id",
        *columns,
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("r") > 0, covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
        (F.length("t") - F.length(F.regexp_replace("t", "[0-9]+", ""))).cast("long").alias("n_digits"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    root = lambda a, b: F.sqrt(a / b)  # noqa: E731  steadies the variance of a share
    return [
        4 * root(F.col("n_symbols"), F.greatest(F.col("word_chars"), F.lit(1))),
        2 * root(F.col("n_dup_lines"), words) * 4,
        4 * root(F.col("n_repeat_words"), words),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        4 * root(F.col("n_digits"), F.greatest(F.col("word_chars"), F.lit(1))),
    ]


def chi_square(x: float, df: int) -> float:
    """Chance that a chi-square variable of `df` degrees is at most x."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = math.exp(a * math.log(x) - x - math.lgamma(a + 1))
    k = 1
    while term > 1e-17 * total:
        term *= x / (a + k)
        total += term
        k += 1
    return min(total, 1.0)


def chi_square_value(chance: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, df) < chance else (low, middle)
    return high


def consistency(share: float, d: int = D) -> float:
    """What the covariance of the closest `share` of normal points has to be multiplied by."""
    return share / chi_square(chi_square_value(share, d), d + 2)


_PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
_ESTIMATE = [*(f"m{i}" for i in range(D)), *(f"l{i}_{j}" for i, j in _PAIRS)]


def _number(value: float) -> str:
    return f"({float(value)!r}D)"


def _distance(whole: Row | None = None) -> Column:
    """Squared distance from x*, location m* and factor l*_* (columns, or numbers of a row), by forward substitution."""
    at = (lambda c: c) if whole is None else lambda c: _number(whole[c])
    solved: list[str] = []
    for i in range(D):
        z = f"x{i} - {at(f'm{i}')}" + "".join(f" - {at(f'l{i}_{j}')} * {solved[j]}" for j in range(i))
        solved.append(f"(({z}) / {at(f'l{i}_{i}')})")
    return F.expr(" + ".join(f"{z} * {z}" for z in solved))


def _factor(groups: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l*_* of c*_*, one column after the other (a row per group)."""
    made = []
    for i, j in _PAIRS:
        value = f"c{i}_{j}" + "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
        made.append((f"sqrt(greatest({value}, 1e-9D))" if i == j else f"({value}) / l{j}_{j}") + f" AS l{i}_{j}")
    return groups.selectExpr("*", *made)


def _shrunk(groups: DataFrame, keys: list[str], whole: Row | None, prior: float) -> DataFrame:
    """m* and c*_* of every group of n as if `prior` more documents had those of all, and their factor."""
    names = [*(f"m{i}" for i in range(D)), *(f"c{i}_{j}" for i, j in _PAIRS)]
    if whole is not None:
        weight = f"(n / (n + {_number(prior)}))"
        groups = groups.selectExpr(*keys, *(f"{weight} * {c} + (1 - {weight}) * {_number(whole[c])} AS {c}" for c in names))
    return _factor(groups)


def _middle(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The median of `bin` by keys, where `n` counts it."""
    by = Window.partitionBy(*keys)
    ranked = cells.withColumns({"upto": F.sum("n").over(by.orderBy("bin")), "all": F.sum("n").over(by)})
    return ranked.where(2 * F.col("upto") >= F.col("all")).groupBy(*keys).agg(F.min("bin").alias("middle"))


def _start(cells: DataFrame, keys: list[str], whole: Row | None, prior: float) -> DataFrame:
    """Medians and median absolute deviations, from counts of (keys, i, bin) in hundredths of x*."""
    cells = cells.groupBy(*keys, "i", "bin").agg(F.sum("n").alias("n"))
    middle = _middle(cells, [*keys, "i"])
    apart = cells.join(middle, [*keys, "i"]).withColumn("bin", F.abs(F.col("bin") - F.col("middle"))).groupBy(*keys, "i", "bin").agg(F.sum("n").alias("n"))
    spread = _middle(apart, [*keys, "i"]).withColumnRenamed("middle", "spread")
    sizes = cells.groupBy(*keys, "i").agg(F.sum("n").alias("n"))
    each = middle.join(spread, [*keys, "i"]).join(sizes, [*keys, "i"])
    pick = lambda c, i: F.expr(f"max(CASE WHEN i = {i} THEN {c} END) / 100")
    groups = each.groupBy(*keys).agg(F.max("n").alias("n"), *(pick("middle", i).alias(f"m{i}") for i in range(D)), *(pick("spread", i).alias(f"d{i}") for i in range(D)))
    groups = groups.selectExpr(*keys, "n", *(f"m{i}" for i in range(D)), *(f"pow(1.4826D * d{i}, 2) + {_number(FLOORS[i] ** 2)} AS c{i}_{j}" if i == j else f"0.0D AS c{i}_{j}" for i, j in _PAIRS))
    return _shrunk(groups, keys, whole, prior)


def _step(rows: DataFrame, keys: list[str], share: float, within: float | None, whole: Row | None, prior: float) -> DataFrame:
    """New estimates from the closest `share` of each group of rows (keys, x*, dist), or from those `within` a distance."""
    sums = [f"m{i}" for i in range(D)] + [f"c{i}_{j}" for i, j in _PAIRS]
    of = [f"x{i}" for i in range(D)] + [f"x{i} * x{j}" for i, j in _PAIRS]
    place = lambda v: F.expr(f"CAST(floor(16 * log2(greatest({v}, 1e-9D))) AS INT)")
    cells = rows.groupBy(*keys, place("dist").alias("bin")).agg(F.count(F.lit(1)).alias("n"), *(F.expr(f"sum({x}) AS {c}") for c, x in zip(sums, of, strict=True)))
    by = Window.partitionBy(*keys)  # of some hundred bins
    before = F.coalesce(F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.row_number().over(by.orderBy("bin")) == 1
    ranked = cells.withColumns({"before": before, "all": F.sum("n").over(by), "first": first})
    inner = F.col("before") < share * F.col("all") if within is None else F.col("first") | (F.col("bin") <= place(_number(within)))
    groups = ranked.where(inner).groupBy(*keys).agg(F.sum("n").alias("n"), *(F.sum(k).alias(k) for k in sums))
    scale = _number(consistency(share if within is None else chi_square(within, D)))
    moments = [f"{scale} * (c{i}_{j} / n - m{i} * m{j} / n / n) + {_number(FLOORS[i] ** 2 if i == j else 0.0)} AS c{i}_{j}" for i, j in _PAIRS]
    groups = groups.selectExpr(*keys, "n", *moments, *(f"m{i} / n AS m{i}" for i in range(D)))
    return _shrunk(groups, keys, whole, prior)


def _plan(share: float, steps: int) -> list[tuple[float, float | None]]:
    return [(share, None)] * steps + [(share, chi_square_value(REWEIGHT, D))]


def estimate(rows: DataFrame, keys: list[str], share: float = SHARE, steps: int = STEPS, prior: float = PRIOR, heavy: DataFrame | None = None) -> tuple[DataFrame, Row | None]:
    """Location m* and Cholesky factor l*_* of every group of rows (keys, x*), and of all rows (none of no rows)."""
    parts = F.array(*(F.struct(F.lit(i).alias("i"), F.floor(100 * F.col(f"x{i}") + 0.5).cast("int").alias("bin")) for i in range(D)))
    cells = materialise(rows.select(*keys, F.inline(parts)).groupBy(*keys, "i", "bin").agg(F.count(F.lit(1)).alias("n")), "mcd")
    whole = _start(cells, [], None, prior).first()
    if whole is None or whole["m0"] is None:
        return _start(cells, keys, None, prior).select(*keys, *_ESTIMATE), None
    for how in _plan(share, steps):
        whole = _step(rows.withColumn("dist", _distance(whole)), [], *how, None, prior).first()
    groups = materialise(_start(cells, keys, whole, prior).select(*keys, *_ESTIMATE), "mcd")
    for how in _plan(share, steps):
        near = lookup(rows, groups, keys, "inner", heavy).withColumn("dist", _distance())
        groups = materialise(_step(near, keys, *how, whole, prior).select(*keys, *_ESTIMATE), "mcd")
    return groups, whole


def judge(docs: DataFrame, lang: str = "lang", source: str = "source", level: float = LEVEL, prior: float = PRIOR) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance)."""
    keys = ["k_lang", "k_source"]
    named = docs.select("doc_id", "text", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(k) for c, k in zip((lang, source), keys, strict=True)))
    rows = statistics(named, *keys).withColumn("base_failed", base_failed())
    rows = materialise(rows.withColumns({f"x{i}": v for i, v in enumerate(_vector())}), "statistics")
    heavy = heavy_keys(rows, keys)
    groups, whole = estimate(rows.where("not base_failed").select(*keys, *(f"x{i}" for i in range(D))), keys, prior=prior, heavy=heavy)
    out = lookup(rows, groups, keys, "left", heavy)
    if whole is not None:  # groups of which every document fails the base rule have no estimate of their own
        out = out.withColumns({c: F.coalesce(c, F.lit(float(whole[c]))) for c in _ESTIMATE})
    cut = chi_square_value(1 - level, D)
    verdict = out.withColumn("distance", _distance())
    return verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)).alias("kept"), "distance")
