import math
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm import brute
from tidemark.llm import context_tree, decontamination, exchange, language_id, ngram_join, packing, pii, robust_outliers, sampling, site_quality, skew, substring_dedup, training_order
from tidemark.llm.tokens import default_tokenizer, encoder

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(brute.hard_rows(), brute.DDL).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module", params=["hard", "docs", "empty"])
def corpus(request, hard, docs):
    return {"hard": hard, "docs": docs, "empty": hard.where("false")}[request.param]


def test_substring_dedup(corpus):
    assert rows(substring_dedup.digest(substring_dedup.remove_repeats(corpus))) == brute.repeats(pairs(corpus))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_ngram_join(corpus, n, percent):
    got = rows(ngram_join.link_components(corpus, n, percent).select("doc_id", "n_shingles", "component_id"))
    assert got == brute.components(pairs(corpus), n, percent)


def test_ngram_join_of_a_large_family(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 16)
    base = brute.sentence(9, 200).split()
    made = []
    for i in range(150):
        w = list(base)
        for k in range(i % 7):
            w[(i * 31 + k * 41) % 200] = f"new{i}_{k}"
        made.append((i, " ".join(w)))
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(ngram_join.link_components(df, 3, 90).select("doc_id", "n_shingles", "component_id")) == brute.components(made, 3, 90)


def test_ngram_join_with_heavy_keys(spark, corpus, monkeypatch):
    monkeypatch.setattr(skew, "FLOOR", 8)
    monkeypatch.setattr(skew, "HEAVY", 12)
    monkeypatch.setattr(ngram_join, "TILE", 4)
    got = rows(ngram_join.link_components(corpus, 3, 90).select("doc_id", "n_shingles", "component_id"))
    assert got == brute.components(pairs(corpus), 3, 90)


def test_tiles_of_a_shared_passage(spark, monkeypatch):
    """Many documents that share most of their words and link with one other each: few tiles meet."""
    monkeypatch.setattr(ngram_join, "TILE", 16)
    met = []
    tile_pairs = ngram_join._tile_pairs
    monkeypatch.setattr(ngram_join, "_tile_pairs", lambda *a: met.append(tile_pairs(*a)) or met[0])
    passage = brute.sentence(9, 160)
    made = [(2 * i + k, f"{brute.sentence(1000 + i, 40)} {passage}") for i in range(400) for k in (0, 1)]
    made = [(d, t + (" more" if d % 2 else "")) for d, t in made]
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = rows(ngram_join.link_components(df, 3, 90).select("doc_id", "component_id"))
    assert got == Counter({(d, d - d % 2): 1 for d, _ in made})
    tiles = -(-len(made) // 16)
    assert not met or met[0].count() < tiles * (tiles + 1) // 4


def test_lookup_is_a_left_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "FLOOR", 10)
    left = exchange.materialise(spark.range(900).selectExpr("if(id % 3 = 0, 7L, if(id % 50 = 1, null, id % 40)) AS k", "id"), "left")
    right = spark.range(0, 40, 3).selectExpr("id AS k", "id * 2 AS v").unionByName(spark.createDataFrame([(7, 1), (None, 5)], "k long, v long"))
    heavy = skew.heavy_keys(left, ["k"])
    assert 7 in {r["k"] for r in heavy.collect()}
    assert rows(skew.lookup(left, right, ["k"], "left", heavy)) == rows(left.join(right, "k", "left"))
    assert rows(skew.lookup(left, right, ["k"], "inner", heavy)) == rows(left.join(right, "k"))


def test_decontamination(spark, corpus):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").unionByName(spark.createDataFrame([(900, brute.sentence(4, 15)), (901, "Two WORDS"), (902, None), (903, "..."), (900, "one")], "item_id long, text string"))
    want = brute.leaks(pairs(corpus), [tuple(r) for r in items.collect()])
    got = decontamination.find(corpus, items)
    assert rows(decontamination.digest(got).drop("n_near_items")) == want
    marked = decontamination.mark(corpus, items)
    assert marked.columns == [*corpus.columns, "n_hit"]
    assert Counter((r["doc_id"], r["n_hit"]) for r in marked.collect()) == Counter((k[0], k[2]) for k in want.elements())


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = brute.leaks(pairs(docs), [(r["item_id"], r["text"]) for r in items.collect()])
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 500)
    assert rows(decontamination.digest(decontamination.find(docs, items)).drop("n_near_items")) == want


def test_near_matches_need_no_exact_phrase(spark):
    item = spark.createDataFrame([(1, "a1 b1 c1 d1 e1 f1 g1 h1 i1 j1")], "item_id long, text string")
    df = spark.createDataFrame([(1, "a1 b1 c1 d1 new e1 f1 g1 h1 i1 j1"), (2, "a1 b1")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["near_items"]) for r in decontamination.find(df, item, slack=2).collect()}
    assert got == {1: (0, ["1"]), 2: (0, [])}


@pytest.mark.parametrize("block", [4_000_000, 400])
def test_near_matches_equal_a_plain_version(spark, docs, monkeypatch, block):
    """Distinct items across blocks, within documents, however texts fall into shards."""
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rng = np.random.default_rng(2)
    made = [(5000, "a1 b1"), (5001, None)]
    for i in range(60):
        w = brute.ALNUM.findall((items[i % len(items)][1] or "").lower())[:14]
        for _ in range(i % 3):
            w.insert(int(rng.integers(0, len(w))), "extra")
        made.append((6000 + i, " ".join(w)))
    items += [(items[0][0], items[0][1] + " and more words behind it"), (None, items[1][1])]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    found = decontamination.find(df, spark.createDataFrame(items, "item_id long, text string"))
    rows_ = found.collect()
    assert Counter((r["doc_id"], tuple(sorted(r["near_items"]))) for r in rows_) == brute.near_leaks(pairs(df), items)
    assert all(sum(x["end"] - x["start"] for x in r["ranges"] or []) == r["n_hit"] for r in rows_)
    want = brute.leaks(pairs(df), items)
    assert rows(decontamination.digest(found).drop("n_near_items")) == want
    marked = decontamination.mark(df.withColumn("_hit0", df["doc_id"]).withColumn("bits", df["doc_id"]), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter((r["doc_id"], r["n_hit"]) for r in marked.collect()) == Counter((k[0], k[2]) for k in want.elements())


def test_pii(corpus):
    got = pii.digest(pii.find(corpus)).collect()
    import hashlib

    want = Counter()
    for d, t in pairs(corpus):
        spans = brute.base_spans(t or "")
        kinds = Counter(s.split(":")[0] for s in spans)
        want[d, kinds["email"], kinds["ip"], kinds["card"], kinds["phone"], hashlib.sha256(",".join(spans).encode()).hexdigest()] += 1
        for r in got:
            if r["doc_id"] == d and d not in (9,):
                assert set(spans) <= set(r["spans"].split(",")) | {""}
    assert Counter(tuple(r)[:6] for r in got) == want


def test_pii_adds_what_a_greedy_match_hides(spark, docs):
    trees = pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    df = spark.createDataFrame([(1, "the 4539578763621486 4539578763621486 end"), (2, "plain text, no. 12 of 2024")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find(df, trees).collect()}
    assert "card:4:20" in got[1]
    assert got[2] == ""
    assert pii.redact(df, trees).where("doc_id = 1").first()["text"].count("<CARD>") == 2


def test_pii_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, pii.N_FEATURES))
    x[:, 0] = 2
    y = ((x[:, 3] > 0.3) & (x[:, 5] < 0.5)).astype(float)
    trees = pii.Trees().fit(x[:2000], y[:2000]).calibrate(x[2000:], y[2000:], 0.98)
    chosen = trees.chance(x[2000:]) >= trees.thresholds[2]
    assert y[2000:][chosen].mean() >= 0.98
    assert chosen.sum() > 0.7 * y[2000:].sum()


def test_pii_of_a_small_corpus(spark):
    df = spark.createDataFrame([(1, "the 4539578763621486 4539578763621486 end"), (2, "plain text, no. 12 of 2024")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.find(df).collect()}
    assert "card:4:20" in got[1]
    assert got[2] == ""


def test_pii_learns_a_rare_kind_beside_a_frequent_one(spark):
    phones = [(i, " ".join(f"call +1 (212) 555-{(i * 37 + k) % 10000:04d} now" for k in range(60))) for i in range(600)]
    cards = []
    for i in range(80):
        number = f"45395787636{i:04d}"
        cards.append((1000 + i, "pay with " + next(number + c for c in "0123456789" if pii.luhn(number + c)) + " today"))
        cards.append((2000 + i, f"order {number}{next(c for c in '0123456789' if not pii.luhn(number + c))} came"))
    df = spark.createDataFrame([*phones, *cards, (9000, "the 4539578763621486 4539578763621486 end")], "doc_id long, text string")
    trees = pii.train(df, sample=2000)
    assert trees.thresholds[2] <= 1
    assert "card:4:20" in pii.find(df, trees).where("doc_id = 9000").first()["spans"]


def test_pii_candidates_are_wider_than_the_base():
    texts = {(2, "4539578763621486"): "x 45 39 57 87 63 62 14 86 12", (1, "10.0.0.1"): "300.10.0.0.1", (0, "jörg.müller@exämple.de"): "an jörg.müller@exämple.de.", (4, "a1" * 400): "key " + "a1" * 400, (0, "o'neil@localhost"): "o'neil@localhost"}
    for (kind, want), text in texts.items():
        assert want in {text[a:b].replace(" ", "") for k, a, b in pii.candidates(text) if k == kind}, text
    digits = " ".join("4539578763621486")
    assert (2, 0, 31) in pii.candidates(digits + " 7 1")


def test_pii_adds_an_address_of_other_letters(spark):
    df = spark.createDataFrame([(1, "write to jörg@exämple.de or call"), (2, "no address @ all, @name")], "doc_id long, text string")
    assert {r["doc_id"]: r["spans"] for r in pii.find(df).collect()} == {1: "email:9:24", 2: ""}


@pytest.mark.parametrize("scale", ["0.001", "0.01", "0.1"])
def test_pii_acts_alike_at_every_size(spark, scale):
    """Planted tokens, most of them not assigned to anything, are caught beside any corpus; plain words and slugs are not."""
    rng = np.random.default_rng(5)
    made = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(50)]
    planted = [(10**9 + i, f"we saw {'token = ' if i % 5 == 0 else ''}{t} there") for i, t in enumerate(made)]
    clean = [(2 * 10**9, "see anno-domini-2024-long-name and Supercalifragilistic or MAX_LINE_LENGTH_120_BYTES, no. 4539 5787 6362 1487 of 12")]
    docs = spark.read.parquet(f"/root/testdata/sf{scale}/documents.parquet").select("doc_id", "text")
    df = docs.unionByName(spark.createDataFrame(planted + clean, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in pii.find(df).where("doc_id >= 1000000000").collect()}
    caught = sum(f"secret:{t.index(s)}:{t.index(s) + 40}" in got[d]["spans"].split(",") for (d, t), s in zip(planted, made, strict=True))
    assert caught >= 0.9 * len(planted)
    assert got[2 * 10**9]["n_added"] == 0


def test_pii_added_spans_equal_a_plain_version(spark, hard, docs):
    trees = pii.train(docs)
    more = [(500, "the 4539578763621486 4539578763621486 end"), (501, "write jörg@exämple.de key " + "a1b2" * 12)]
    df = docs.select("doc_id", "text").unionByName(hard.where("doc_id is not null").selectExpr("doc_id + 1000 AS doc_id", "text")).unionByName(spark.createDataFrame(more, "doc_id long, text string")).distinct()
    got = Counter((r["doc_id"], r["spans"], r["n_added"]) for r in pii.find(df, trees).collect())
    want = Counter()
    for d, text in pairs(df):
        text = text or ""
        base = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in brute.base_spans(text))]
        apart = lambda s, others: all(s[2] <= o[1] or o[2] <= s[1] for o in others)
        scored = [(s, float(trees.chance(pii.features(text, [s]))[0])) for s in pii.candidates(text)]
        added = []
        for s, p in sorted(scored, key=lambda x: -x[1]):
            ruled = s[0] in (0, 4) or any(x.startswith(f"{pii.KINDS[s[0]]}:0:{s[2] - s[1]}") for x in brute.base_spans(text[s[1] : s[2]]))
            if p >= trees.thresholds[s[0]] and ruled and apart(s, base) and apart(s, added):
                added.append(s)
        want[d, ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(base + added)), len(added)] += 1
    assert sum(n for (_, _, n) in want) > 2
    assert got == want


def test_pii_of_a_text_of_megabytes(docs):
    trees = pii.train(docs)
    text = " ".join(f"+1 (212) 555-{i % 10000:04d} and 10.{i % 256}.0.{i % 200}" for i in range(125_000))
    assert len(text) > 4_000_000
    began = time.time()
    (base, _), *_ = pii._select([text], trees)
    assert len(base) == 250_000
    assert time.time() - began < 60


def test_pii_learns_from_all_candidates(spark):
    """No candidate is left out at any weight of the corpus, and passes over the table equal one fit of all rows."""
    made = [(i, f"call +1 (212) 555-{i:04d} or mail user{i % 7}@host{i % 40}.org, no. 12 of 10.0.{i % 300}.{i % 400}") for i in range(900)]
    df = spark.createDataFrame(made + made[:300], "doc_id long, text string").repartition(5)
    found = [(y, x) for _, text in made for s in [pii.candidates(text)] for y, x in zip(pii.weak_labels(text, s), pii.features(text, s), strict=True) if y >= 0]
    trees = pii.train(df, sample=50)
    assert trees.rows + trees.held == len(found) + sum(map(len, pii.examples().values()))
    corpus = pii.gather(df, sample=10**9)
    assert set(corpus.share.values()) == {1.0}
    learned = [(r["y"], np.frombuffer(r["x"], dtype=np.float32).astype(float)) for r in corpus.table.where("not held").collect() for _ in range(r["n"])]
    y, x = (np.array(c) for c in zip(*learned, strict=True))
    plain, passes = pii.Trees(rounds=3).fit(x, y.astype(float)), pii.Trees(rounds=3).fit(x[:0], y[:0].astype(float), corpus=corpus)
    assert plain.rows == passes.rows == len(y) and np.allclose(plain.chance(x), passes.chance(x), atol=1e-6)


def test_pii_sample_shares():
    assert pii.quotas({(2, 1): 10, (3, 1): 10**9, (3, 0): 10**9}, 1010) == {(2, 1): 10, (3, 0): 500, (3, 1): 500}
    assert pii.quotas({}, 10) == {}


def test_packing(corpus):
    got = packing.pack(corpus).collect()
    encode = encoder(default_tokenizer())
    want = Counter()
    for d, t in pairs(corpus):
        ids = np.append(encode.whole.encode(t or "", add_special_tokens=False).ids, 0).astype("<u4")
        for s in range(0, len(ids), 1024):
            part = ids[s : s + 1024]
            want[d, s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024


def test_patterns_hold_every_piece():
    histogram = {k: (k * 7919) % 300 for k in range(1, 1025)}
    found = packing.patterns(dict(histogram))
    back = Counter()
    for pattern, count in found:
        assert sum(pattern) <= 1024
        for size in pattern:
            back[size] += count
    assert back == Counter({k: v for k, v in histogram.items() if v})
    used = sum(k * v for k, v in histogram.items())
    assert used / (1024 * sum(c for _, c in found)) > 0.97


def test_training_order(spark, corpus):
    root = exchange.scratch(spark, "order")
    table = exchange.materialise(corpus, "corpus")
    got = sorted(training_order.materialise_order(table, root, key=7, length=64, per_shard=32).collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in got] == list(range(len(got)))
    manifest = [(r["shard"], r["records"], r["first_slot"]) for r in spark.read.parquet(f"{root}/manifest.parquet").collect()]
    block = training_order.read_slots(root, manifest, 0, len(got), length=64)
    assert len(block) == len(got)
    total = Counter()
    for r, ids in zip(got, block, strict=True):
        assert zlib.crc32(ids[: r["n_tokens"]].tobytes()) == r["ids_crc32"]
        total.update(ids[: r["n_tokens"]].tolist())
    encode = encoder(default_tokenizer())
    want = Counter(x for _, t in pairs(corpus) for x in [*encode(t).tolist(), 0])
    assert total == want
    assert (training_order.read_slots(root, manifest, 5, 20, length=64) == block[5:25]).all()


def test_training_order_equals_a_plain_permutation(spark, docs):
    """Slots, shards and contents of one input split against a plain cut, a plain Feistel network and a sort; a second run replaces the first."""
    table = exchange.materialise(docs.select("doc_id", "text").coalesce(1), "one-split")
    root, key, length, per_shard = exchange.scratch(spark, "order"), 99, 128, 16
    for _ in range(2):
        got = sorted(training_order.materialise_order(table, root, key=key, length=length, per_shard=per_shard).collect(), key=lambda r: r["slot"])
    encode = encoder(default_tokenizer())
    data = pairs(table)
    stream = [int(x) for _, t in data for x in [*encode(t), 0]]
    cut = [stream[i : i + length] for i in range(0, len(stream), length)]
    n = -(-(sum(len((t or "").encode()) for _, t in data) + len(data)) // length)
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def mixed(h):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = ((h ^ (h >> shift)) * by) % 2**64
        return h ^ (h >> 31)

    def place(x):
        while True:
            a, b = x >> half, x & mask
            for r in range(6):
                a, b = b, a ^ (mixed(b ^ mixed(key * 6 + r)) & mask)
            x = (a << half) | b
            if x < n:
                return x

    order = sorted((place(i), i) for i in range(len(cut)))
    assert [(r["place"], r["shard"]) for r in got] == [(p, p // per_shard) for p, _ in order]
    manifest = [(r["shard"], r["records"], r["first_slot"]) for r in spark.read.parquet(f"{root}/manifest.parquet").collect()]
    block = training_order.read_slots(root, manifest, 0, len(got), length=length)
    assert block.tolist() == [cut[i] + [0] * (length - len(cut[i])) for _, i in order]


@pytest.mark.parametrize("n", [1, 2, 3, 100, 4097])
def test_permutation(n):
    p = training_order.permute(np.arange(n), n, 11)
    assert sorted(p.tolist()) == list(range(n))
    assert (training_order.permute(p, n, 11, inverse=True) == np.arange(n)).all()
    assert n < 50 or (p != training_order.permute(np.arange(n), n, 12)).any()


def test_robust_outliers(corpus):
    got = robust_outliers.judge(corpus).collect()
    want = Counter((d, *brute.statistics(t)) for d, t in pairs(corpus))
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_robust_outliers_keep_clean_text(spark):
    df = robust_outliers.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("not base_failed")
    got = {r["quality"]: r["share"] for r in df.groupBy("quality").agg({"kept": "count"}).withColumnRenamed("count(kept)", "share").collect()}
    kept = {r["quality"]: r["count"] for r in df.where("kept").groupBy("quality").count().collect()}
    assert kept[1] >= 0.99 * got[1]
    assert kept.get(0, 0) <= 0.5 * got[0]


def test_robust_outliers_reject_a_third_of_junk(spark):
    clean = [(i, " ".join(f"w{chr(97 + (i * 7 + k * k) % 26)}{chr(97 + (i + k * 3) % 23)}{chr(97 + (k * i) % 19)}" + "e" * ((i + k) % 4) for k in range(80))) for i in range(130)]
    junk = [(1000 + i, " ".join(f"j{chr(97 + (i + k) % 26)}{chr(97 + (i * k) % 21)}" + "#$" * (1 + (i + k) % 2) for k in range(80))) for i in range(70)]
    df = spark.createDataFrame([(d, t, "en", "hot") for d, t in clean + junk], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in robust_outliers.judge(df).where("not base_failed").collect()}
    assert sum(d >= 1000 for d in got) > 50 and sum(d < 1000 for d in got) > 100
    assert not any(kept for d, kept in got.items() if d >= 1000)
    assert all(kept for d, kept in got.items() if d < 1000)


def test_consistency_factor_and_chi_square():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200_000, 5))
    q = (x**2).sum(axis=1)
    for share in (0.5, 0.75, 0.975):
        assert robust_outliers.chi_square_value(share, 5) == pytest.approx(np.quantile(q, share), rel=0.02)
        inner = x[q <= np.quantile(q, share)]
        assert robust_outliers.consistency(share) * inner.var(axis=0).mean() == pytest.approx(1, rel=0.02)


@pytest.mark.parametrize("floor", [20_000, 5])
def test_robust_outliers_equal_a_plain_version(spark, hard, monkeypatch, floor):
    monkeypatch.setattr(skew, "FLOOR", floor)
    monkeypatch.setattr(skew, "HEAVY", 6)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    hard = hard.select("doc_id", "text", "lang", "source")
    df = docs.select("doc_id", "text", "lang", "source").unionByName(hard.where("doc_id is not null").withColumn("doc_id", hard["doc_id"] + 100_000)).distinct()
    got = {r["doc_id"]: (r["kept"], r["distance"]) for r in robust_outliers.judge(df).collect()}
    want = brute.outliers([tuple(r) for r in df.collect()])
    assert {d: k for d, (k, _) in got.items()} == {d: k for d, (k, _) in want.items()}
    for d, (_, distance) in want.items():
        assert got[d][1] == pytest.approx(distance, rel=1e-6)


def test_robust_outliers_tell_null_from_empty(spark):
    rows = [(i, brute.sentence(i % 7, 60), None if i % 2 else "", "s") for i in range(80)]
    rows += [(100 + i, brute.sentence(i % 7, 60) + " #$" * 30, None, "s") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["distance"] for r in robust_outliers.judge(df).collect()}
    assert got[0] != got[1]


def test_distance_is_mahalanobis(spark):
    rng = np.random.default_rng(1)
    d = len(robust_outliers.VECTOR)
    a = rng.normal(size=(d, d))
    cov, x, m = a @ a.T + np.eye(d), rng.normal(size=d), rng.normal(size=d)
    values = {f"x{i}": float(x[i]) for i in range(d)} | {f"m{i}": float(m[i]) for i in range(d)} | {f"c{i}_{j}": float(cov[i, j]) for i in range(d) for j in range(i + 1)}
    df = robust_outliers._factor(spark.createDataFrame([tuple(values.values())], list(values)))
    got = df.select(robust_outliers._distance().alias("q")).first()["q"]
    assert got == pytest.approx((x - m) @ np.linalg.solve(cov, x - m))


def naive_tree(seqs, train, depth):
    counts = Counter()

    def nodes(s, i):
        context = tuple(s[i - k] if i >= k else 10 for k in range(1, depth + 1))
        for j in range(8):
            yield [(context[:k], (1 << j) | (s[i] >> (8 - j))) for k in range(depth + 1)], (s[i] >> (7 - j)) & 1

    for s in train:
        for i in range(len(s)):
            for path, bit in nodes(s, i):
                for node in path:
                    counts[node, bit] += 1
    below = defaultdict(set)
    for (context, node), _ in counts:
        if context:
            below[context[:-1], node].add((context, node))
    memo = {}

    def kt(node):
        a, b = counts[node, 0], counts[node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def mixed(node):
        if node not in memo:
            memo[node] = kt(node) if len(node[0]) == depth else math.log(0.5) + float(np.logaddexp(kt(node), sum(mixed(k) for k in below[node])))
        return memo[node]

    for s in seqs:
        total = 0.0
        for i in range(len(s)):
            for path, bit in nodes(s, i):
                p = None
                for node in reversed(path):
                    direct = (counts[node, bit] + 0.5) / (counts[node, 0] + counts[node, 1] + 1)
                    stop = math.exp(math.log(0.5) + kt(node) - mixed(node))
                    p = direct if p is None else stop * direct + (1 - stop) * p
                total += math.log10(p)
        yield total


@pytest.mark.parametrize("depth", [2, 3])
def test_context_tree(hard, depth):
    few = hard.where("doc_id is null or doc_id not in (16, 17)")
    got = context_tree.score(few, depth=depth).collect()
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    data = [(d, (t or "").encode().translate(lower).split()) for d, t in pairs(few)]
    known = [w for d, w in data if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    counts = Counter(x for w in known for x in [*w, None])
    n, v = sum(counts.values()), len(counts)
    text = lambda w: b" ".join(w) + b"\n"
    want = sorted((repr(d), len(w) + 1, sum(counts[x] > 0 for x in [*w, None]), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in [*w, None]), 6), round(s, 2)) for (d, w), s in zip(data, naive_tree([text(w) for _, w in data], [text(w) for w in known], depth), strict=True))
    assert all(r["train_tokens"] == n for r in got)
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 2)) for r in got) == want


def test_context_tree_in_salted_buckets(hard, docs, monkeypatch):
    more = docs.select("doc_id", "text").unionByName(hard.select("doc_id", "text"))
    want = Counter((r["doc_id"], r["n_known"], round(r["score"], 2)) for r in context_tree.score(more).collect())
    monkeypatch.setattr(context_tree, "SALTED_GROUPS", 5)
    assert Counter((r["doc_id"], r["n_known"], round(r["score"], 2)) for r in context_tree.score(more).collect()) == want


def test_columns_of_clashing_names_are_ignored(spark, docs):
    df = docs.withColumns({"g": docs["doc_id"], "learn": docs["source"], "bucket": docs["source"], "shard": docs["text"], "pos": docs["doc_id"], "vals": docs["text"]})
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    plain = docs.select("doc_id", "text")
    assert rows(context_tree.score(df).select("doc_id", "n_known")) == rows(context_tree.score(plain).select("doc_id", "n_known"))
    assert rows(decontamination.digest(decontamination.find(df, items))) == rows(decontamination.digest(decontamination.find(plain, items)))


def test_context_tree_of_nothing(hard):
    assert context_tree.score(hard.where("false")).collect() == []


def test_language_id(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.94


def test_language_id_of_hard_rows(hard):
    got = language_id.identify(hard).collect()
    assert len(got) == hard.count()
    for r in got:
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (5, 6, 7, 22) and r["doc_id"] != 22)
    assert language_id.identify(hard.where("false")).collect() == []


@pytest.mark.parametrize("at_a_time", [100, 2])
def test_language_id_equals_a_plain_version(spark, hard, docs, monkeypatch, at_a_time):
    import zstandard

    monkeypatch.setattr(language_id, "LANGUAGES", at_a_time)
    df = exchange.materialise(docs.select("doc_id", "text", "lang").unionByName(hard.where("doc_id is not null").selectExpr("doc_id + 10000 AS doc_id", "text", "lang")), "languages")
    known = language_id.pieces(df.where("pmod(crc32(cast(doc_id AS string)), 5) <> 0"))
    books = {}
    for k, n in language_id.languages(known).items():
        books |= language_id.learn(known, {k: n})
    assert all(len(b) <= language_id.DICTIONARY_BYTES for b in books.values())
    want = Counter()
    for d, text in pairs(df):
        plain = " ".join("".join(c if c.isalpha() or not (c.isdigit() or c == "_" or not c.isalnum()) else " " for c in (text or "").lower()).split())
        size = {}
        for k, b in books.items():
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(b, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            raw = f" {plain} ".encode()
            size[k] = sum(len(c.compress(raw[i : i + 4096])) for i in range(0, len(raw), 4096))
        best = sorted((n, k) for k, n in size.items())
        if not any(map(str.isalpha, plain)):
            want[d, "und", 0.0] += 1
        else:
            want[d, best[0][1], round(1 / (1 + math.exp(-min(best[1][0] - best[0][0], 200) / 4)), 9)] += 1
    assert Counter((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(df).collect()) == want


def test_language_learns_from_any_place_of_long_texts(spark):
    """Stubs and shared openings do not keep a language from its long texts."""
    opening = "the same opening lines stand before every text of the table " * 150
    rows = [(i, "¡ah!" if i % 40 else opening + ("vento mare luna sole " if lang == "xx" else "der wind und das meer ") * 900, lang) for lang, base in (("xx", 0), ("yy", 10_000)) for i in range(base, base + 800)]
    rows += [(50_000 + i, text, None) for i, text in enumerate(["mare luna", "das meer und der wind", "sole vento luna mare"])]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id >= 50000").collect()}
    assert got == {50_000: "xx", 50_001: "yy", 50_002: "xx"}


def test_site_quality(spark):
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = site_quality.classify(df, labels).join(labels, "doc_id").groupBy("quality", "toxic").agg({"kept": "count"}).collect()
    kept = {(r["quality"], r["toxic"]): r["count"] for r in site_quality.classify(df, labels).where("kept").join(labels, "doc_id").groupBy("quality", "toxic").count().collect()}
    total = {(r["quality"], r["toxic"]): r["count(kept)"] for r in got}
    assert kept[1, 0] >= 0.99 * total[1, 0]
    assert kept.get((1, 1), 0) <= 0.1 * total[1, 1]
    assert kept.get((0, 0), 0) <= 0.1 * total[0, 0]


@pytest.mark.parametrize("floor", [20_000, 5])
def test_site_quality_equals_a_plain_version(spark, hard, docs, monkeypatch, floor):
    """Hierarchical rates, strengths and posteriors by plain Python, from the fitted weights."""
    import pyarrow as pa

    monkeypatch.setattr(skew, "FLOOR", floor)
    monkeypatch.setattr(skew, "HEAVY", 6)

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    labels = labels.unionByName(labels.limit(20).withColumn("quality", labels["quality"] * 0))  # repeated and conflicting
    more = spark.createDataFrame([(7000 + i, f"plain words {i} here", None if i % 2 else "", "") for i in range(9)], "doc_id long, text string, source string, lang string")
    df = docs.select("doc_id", "text", "source", "lang").unionByName(hard.select("doc_id", "text", "source", "lang")).unionByName(more)
    weights = site_quality.fit(df, labels)
    monkeypatch.setattr(site_quality, "fit", lambda *a: weights)
    got = site_quality.classify(df, labels).collect()
    data = [tuple(r) for r in df.collect()]
    cells = [np.unique(site_quality._features(pa.table({"text": pa.array([t], pa.string())}))[1]) for _, t, _, _ in data]
    w = weights.astype(np.float32)
    evidence = [[float(np.clip(w[c, k].astype(float).sum() + w[site_quality.CELLS, k], -12, 12)) for k in (0, 1)] for c in cells]
    prior = weights[site_quality.CELLS + 1]
    chance = [[1 / (1 + math.exp(-(e[k] + prior[k]))) for k in (0, 1)] for e in evidence]
    good = defaultdict(lambda: 1.0)
    for k in (0, 1):
        paths, hosts = defaultdict(list), defaultdict(list)
        for (_, _, source, lang), p in zip(data, chance, strict=True):
            paths[source, lang].append(p[k])
            hosts[source].append(p[k])
        n, mean = len(data), sum(p[k] for p in chance) / len(data)
        rate = {s: sum(v) / len(v) for s, v in paths.items()}
        of_host = {s: sum(v) / len(v) for s, v in hosts.items()}
        within = sum((x - rate[s]) ** 2 for s, v in paths.items() for x in v) / (n - len(paths))
        held = sum(len(v) * (rate[s] - of_host[s[0]]) ** 2 for s, v in paths.items())
        tau = (held - (len(paths) - len(hosts)) * within) / (n - sum(len(v) ** 2 / len(hosts[s[0]]) for s, v in paths.items()))
        path = min(max(within / tau, 1.0), 1e6) if tau > 0 else 1e6
        held = sum(len(v) * (of_host[s] - mean) ** 2 for s, v in hosts.items())
        tau = (held - (len(hosts) - 1) * within) / (n - sum(len(v) ** 2 for v in hosts.values()) / n)
        host = min(max(within / tau, 1.0), 1e6) if tau > 0 else 1e6
        shrunk_host = {s: (sum(v) + host * mean) / (len(v) + host) for s, v in hosts.items()}
        for i, (_, _, source, lang) in enumerate(data):
            v = paths[source, lang]
            r = min(max((sum(v) + path * shrunk_host[source]) / (len(v) + path), 1e-4), 1 - 1e-4)
            good[i] *= 1 - 1 / (1 + math.exp(-(evidence[i][k] + math.log(r / (1 - r)))))
    key = lambda d, host, path, p: (repr(d), repr(host), repr(path), round(p, 4))
    assert Counter(key(r["doc_id"], r["host"], r["path"], r["p_good"]) for r in got) == Counter(key(d, source, lang, good[i]) for i, (d, _, source, lang) in enumerate(data))
    assert all(r["kept"] == (r["p_good"] >= 0.5) for r in got)


def test_site_quality_keeps_columns_of_any_name(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    df = docs.withColumn("kept", docs["doc_id"]).withColumn("host_key", docs["source"]).withColumn("host", docs["source"])
    out = site_quality.keep_good(df, labels)
    assert out.columns == df.columns
    assert 0 < out.where("kept = doc_id and host_key = source").count() == out.count() <= docs.count()


def test_site_quality_without_labels(spark, hard):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert site_quality.keep_good(hard, none).count() == hard.count()
    assert site_quality.keep_good(hard, none).columns == hard.columns
    assert site_quality.classify(hard.where("false"), none).count() == 0


def test_bounded_sample_is_that_of_a_full_sort(spark):
    rows = spark.range(30_000).withColumnRenamed("id", "doc_id")
    want = sorted(r[1] for r in rows.selectExpr("doc_id", "xxhash64(doc_id)").collect())[:500]
    assert sorted(r[0] for r in sampling.smallest(rows, 500, "doc_id").selectExpr("xxhash64(doc_id)").collect()) == want
    assert sampling.smallest(rows.limit(20), 500, "doc_id").count() == 20
    assert sampling.smallest(rows.limit(0), 500, "doc_id").count() == 0


def test_language_with_long_texts_only_is_learned(spark):
    long, short = "vento mare luna sole " * 2000, "der wind und das meer"
    rows = [(i, long if i % 2 else short, "xx" if i % 2 else "yy") for i in range(40)] + [(99, "½ 12", "yy")]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got.pop(99) == "und"
    assert got == {i: "xx" if i % 2 else "yy" for i in range(40)}
