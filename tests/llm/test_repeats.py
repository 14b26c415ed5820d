"""Tables of which one id, or one equal row, holds a third and more: against plain Python, with the largest group and the driver's rows."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import context_tree, decontamination, exchange, language_id, ngram_join, packing, pii, site_quality, substring_dedup, training_order
from tidemark.llm.tokens import default_tokenizer, encoder

DDL = "doc_id long, text string, lang string, source string, n_chars long"
MANY = 1200


@pytest.fixture(scope="module")
def repeated(spark):
    """A third equal rows, a third rows of one id with texts of their own, and others."""
    same = (5, brute.sentence(1, 90) + " mail@example.org", "en", "s1", 1)
    one_id = [(77, brute.sentence(k % 300, 60) + f" +1 212 555 {1000 + k}", "de", "s2", 1) for k in range(MANY)]
    others = [r[:5] for r in brute.hard_rows()] + [(1000 + k, brute.sentence(k % 211, 55 + k % 9), "fr", "s3", 1) for k in range(MANY // 3)]
    rows = [same] * MANY + one_id + others
    df = spark.createDataFrame(rows, DDL).repartition(6)
    return exchange.materialise(df, "repeated")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_no_group_holds_the_repeated_rows(spark, repeated):
    plan = exchange.Plan(repeated)
    grouped = plan.grouped(repeated)
    total = repeated.count()
    assert grouped.agg(F.sum("copies")).first()[0] == total
    assert grouped.groupBy("g").count().agg(F.max("count")).first()[0] < 3 * total / plan.groups + exchange.REPEATS_LEAST
    assert rows(exchange.expanded(grouped.drop("g"))) == rows(repeated.select("doc_id", "text"))
    dealt = ngram_join.dealt(plan.reduced(repeated.select("doc_id", "text")), plan)
    assert dealt.groupBy("g").count().agg(F.max("count")).first()[0] < 3 * total / plan.groups + exchange.REPEATS_LEAST


def test_substring_dedup(repeated):
    assert rows(substring_dedup.digest(substring_dedup.remove_repeats(repeated))) == brute.repeats(pairs(repeated))


def test_ngram_join(repeated):
    """Rows that share an id are judged each by its own text."""
    got = ngram_join.link_components(repeated, 3, 90).select("doc_id", "n_shingles", "component_id")
    assert rows(got) == brute.components(pairs(repeated), 3, 90)


def test_context_tree_counts_every_copy(repeated):
    """The same scores as when nothing is counted instead of kept."""
    got = context_tree.score(repeated)
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    least, exchange.REPEATS_LEAST = exchange.REPEATS_LEAST, 10**9
    try:
        want = context_tree.score(repeated)
        key = lambda df: Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 4)) for r in df.collect())
        assert key(got) == key(want)
    finally:
        exchange.REPEATS_LEAST = least


def test_site_quality_fits_on_one_row_of_an_id(spark, repeated, monkeypatch):
    labels = spark.createDataFrame([(5, 1, 0), (77, 0, 0), (77, 0, 0), (1001, 1, 0), (1002, 0, 1)], "doc_id long, quality int, toxic int")
    seen = []
    plain = site_quality.materialise
    monkeypatch.setattr(site_quality, "materialise", lambda df, name: seen.append((name, out := plain(df, name))) or out)
    site_quality.fit(repeated, labels, sample=20)
    assert dict(seen)["sampled"].count() == 4
    assert site_quality.classify(repeated, labels).count() == repeated.count()


def test_every_language_has_a_dictionary(spark, monkeypatch):
    """One whose rows all have one id, one that only repeats a row, and one of other texts."""
    one, two = [d for d in range(10) if zlib.crc32(str(d).encode()) % 5][:2]  # not held out
    letters = str.maketrans("0123456789", "abcdefghij")  # digits tell nothing of a language
    made = [(one, brute.sentence(k, 30).translate(letters), "zz", "s", 1) for k in range(900)]
    made += [(two, "ohne viele worte steht dieser satz immer wieder da", "yy", "s", 1)] * 900
    made += [(k, f"plain words number {k} of the third one", "xx", "s", 1) for k in range(100, 700)]
    df = spark.createDataFrame(made, DDL).repartition(5)
    for d in (3, 4, 5, 6, 7):  # also with ids whose hash lies elsewhere
        moved = df.withColumn("doc_id", F.when(F.col("doc_id") < 10, F.col("doc_id") + 10 * d).otherwise(F.col("doc_id")))
        found = language_id.pieces(moved)
        known = language_id.learn(found, language_id.languages(found), dictionary_bytes=3_000)
        assert set(known) == {"xx", "yy", "zz"}
        assert all(len(v) <= 3_000 for v in known.values()) and min(len(known[k]) for k in ("xx", "zz")) > 1_000
    assert language_id.identify(df).where(f"lang_pred = 'zz' and doc_id = {one}").count() > 700


def test_pii_strata_hold_each_candidate_once(spark, repeated, monkeypatch):
    taken = []
    fit = pii.Trees.fit
    monkeypatch.setattr(pii.Trees, "fit", lambda self, x, y, *a, **k: taken.append(len(y)) or fit(self, x, y, *a, **k))
    pii.train(repeated, sample=200)
    assert taken[0] <= 200 + sum(map(len, pii.examples().values()))
    found = pii.find(repeated)
    assert found.count() == repeated.count()
    assert found.where("doc_id = 5 and n_email = 1").count() == MANY


def test_decontamination_of_repeated_items(spark, repeated, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 2_000)
    items = [(1, brute.sentence(1, 30))] * 500 + [(k, brute.sentence(k % 300, 20)) for k in range(2, 40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    count, blocks = decontamination._blocks(benchmark, 10)
    assert count < 20 and sum(1 for _ in blocks) == count
    want = brute.leaks(pairs(repeated), items)
    assert rows(decontamination.digest(decontamination.find(repeated, benchmark)).drop("n_near_items")) == want
    named = repeated.select("doc_id", "text", F.lit("x").alias("n_hit"), F.lit(2).alias("N_HIT_1"))
    marked = decontamination.mark(named, benchmark)
    assert marked.columns == ["doc_id", "text", "n_hit", "N_HIT_1", "n_hit_2"]
    assert Counter((r["doc_id"], r["n_hit"], r["n_hit_2"]) for r in marked.collect()) == Counter((k[0], "x", k[2]) for k in want.elements())


def test_training_order_and_packing(spark, repeated, tmp_path):
    encode = encoder(default_tokenizer())
    ids = Counter((d, len(encode(t)) + 1) for d, t in pairs(repeated))
    packed = packing.pack(repeated)
    assert packed.agg(F.sum("length")).first()[0] == sum(n * c for (_, n), c in ids.items())
    order = training_order.materialise_order(repeated, f"file://{tmp_path}/order", key=7)
    assert order.count() > 0
