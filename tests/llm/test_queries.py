from collections import Counter

import pytest

from tests.oracle import compare
from tidemark.llm.queries import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_agrees_with_duckdb(spark, name):
    compare(spark, SMALL, queries()[name], oracle_sql()[name])


def test_pipeline(spark):
    """Stages against what brute force says of each stage's own input."""
    import corpus_pipeline
    from tests.llm import brute
    from tidemark.llm import exchange

    out = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in out.collect()]
        out = exchange.materialise(stage(spark, out, SMALL), "test-stage")
        after = out.collect()
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        if name == "quality_classifier":
            labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
            kept = {r["doc_id"] for r in after}
            good, bad = ([d for d, _ in before if d in labels and (labels[d] == (1, 0)) == want] for want in (True, False))
            assert set(map(tuple, out.collect())) <= set(map(tuple, spark.read.parquet(f"{SMALL}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()))
            assert sum(d in kept for d in good) >= 0.97 * len(good)
            assert sum(d in kept for d in bad) <= 0.5 * len(bad)  # of some fifty labels; test_site_quality has more
        if name == "ngram_jaccard_join":
            assert {r["doc_id"] for r in after} == {c for _, _, c in brute.components(before, 5, 80)}
        if name == "benchmark_decontamination":
            assert {r["doc_id"] for r in after} == {k[0] for k in brute.leaks(before, items) if not k[5]}
        if name == "pii":
            assert len(after) == len(before)
            assert not any(brute.base_spans(r["text"] or "") for r in after)
        if name == "packing":
            assert {r["doc_id"] for r in after} == {d for d, _ in before}


def test_one_row_of_each_group_of_near_duplicates_stays(spark):
    """Rows of repeated and null ids, counted, against brute force over row numbers."""
    import corpus_pipeline
    from tests.llm import brute

    a, b = brute.sentence(1, 120), brute.sentence(5, 120)
    near = a.replace("w13x1", "changed", 1)
    more = [(1, a), (1, a), (40, near), (40, b), (30, b), (None, a), (None, a), (None, near), (None, brute.sentence(6, 80)), (None, brute.sentence(6, 80)), (None, None), (None, "")]
    rows = [r[:5] for r in brute.hard_rows()] + [(d, t, "en", "s", 1) for d, t in more]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    groups = {}
    for row, _, group in brute.components([(i, r[1]) for i, r in enumerate(rows)], 5, 80):
        groups.setdefault(group, []).append(rows[row][0])
    want = Counter(min((d for d in ids if d is not None), default=None) for ids in groups.values())
    out = corpus_pipeline.near_duplicates(spark, df, SMALL)
    assert out.columns == corpus_pipeline.COLUMNS
    assert Counter(r["doc_id"] for r in out.collect()) == want


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline
    from tidemark.llm import exchange

    out = spark.read.parquet(f"{SMALL}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = exchange.materialise(stage(spark, out, SMALL), "test-empty")
        assert out.count() == 0, name


def test_pipeline_of_hard_rows(spark):
    """Nulls in any column, empty and long texts and repeated rows go through every stage."""
    import corpus_pipeline
    from tests.llm import brute
    from tidemark.llm import exchange

    rows = [r[:5] for r in brute.hard_rows()] + [(None, None, None, None, None), (77, "x" * 200_000, None, "s", 1)]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    counts = []
    for _, stage in corpus_pipeline.STAGES:
        out = exchange.materialise(stage(spark, out, SMALL), "test-hard")
        counts.append(out.count())
    assert counts[0] > counts[1] > 0 and counts[2] <= counts[1] and counts[3] == counts[2] and counts[4] >= counts[3]
