"""Importance resampling, bottom-k sketches and spelling variants, against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import bitmap, bottom_sketches, components, crc, exchange, skew, spelling_variants, target_resampling

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(brute.hard_rows(), brute.DDL).repartition(3)


@pytest.fixture(scope="module")
def repeated(spark):
    """One id on half of the table, and one equal row on a third of it."""
    rows = brute.hard_rows()
    more = [(77, brute.sentence(k % 40, 90), "en", "s", 1, 1, "b", 2, "k") for k in range(200)] + [rows[0]] * 200
    return spark.createDataFrame(rows + more, brute.DDL).repartition(5)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module", params=["hard", "repeated", "docs", "empty"])
def corpus(request, hard, repeated, docs):
    return {"hard": hard, "repeated": repeated, "docs": docs, "empty": hard.where("false")}[request.param]


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_checksums_of_ranges_and_their_concatenations():
    data = np.frombuffer(random.Random(1).randbytes(5000), dtype=np.uint8)
    start, end = np.array([0, 3, 10, 100, 7]), np.array([0, 9, 74, 4000, 500])
    one = crc.ranges(data, start, end)
    assert one.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]
    both = crc.joined(one[::-1], one, end - start)
    assert both.tolist() == [zlib.crc32(data[a:b].tobytes() + data[c:d].tobytes()) for a, b, c, d in zip(start[::-1], end[::-1], start, end, strict=True)]


def test_bitmap_lets_all_keys_through(spark):
    keys = exchange.materialise(spark.range(3000).selectExpr("xxhash64(id) AS h"), "keys")
    flags = bitmap.build(keys).value
    own = np.array([r["h"] for r in keys.collect()]).view(np.uint64)
    assert bitmap.maybe(flags, own).all()
    others = np.array([r["h"] for r in spark.range(3000, 9000).selectExpr("xxhash64(id) AS h").collect()]).view(np.uint64)
    assert bitmap.maybe(flags, others).mean() < 0.1


def features(text):
    w = brute.ALNUM.findall((text or "").translate(brute.LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resampled(rows_, items, percent):
    made = [(d, *features(t)) for d, t in rows_]
    s, t = Counter(b for _, _, f in made for b in f), Counter(b for x in items for b in features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10_000) / ((s[b] + 1) * (sum(t.values()) + 10_000)))) for b in range(10_000)]
    out = []
    for d, n, f in made:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    fit = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = fit[: percent * len(fit) // 100]
    left = Counter(out) - Counter(drawn)
    return Counter((*r[:4], i + 1, r[4]) for i, r in enumerate(drawn)) + Counter({(*r[:4], None, r[4]): n for r, n in left.items()})


@pytest.mark.parametrize("percent", [5, 60])
def test_target_resampling(spark, corpus, percent):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").unionByName(spark.createDataFrame([(1, None), (1, "")], "item_id long, text string"))
    got = target_resampling.resample(corpus, items, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    assert rows(got) == resampled(pairs(corpus), [r["text"] for r in items.collect()], percent)


def test_target_resampling_without_a_target(spark, hard):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert rows(target_resampling.resample(hard, empty, percent=20)) == resampled(pairs(hard), [], 20)


def test_streams_hold_every_feature_in_order(spark, docs):
    streams = target_resampling.bucket_streams(docs).collect()
    texts = dict(pairs(docs))
    for r in streams:
        ends = np.frombuffer(r["bounds"], dtype="<i8")
        stream = np.frombuffer(r["stream"], dtype="<u2")
        assert len(stream) == (ends[-1] if len(ends) else 0)
        for d, n, a, b in zip(r["ids"], r["words"], [0, *ends[:-1]], ends, strict=True):
            assert (n, Counter(stream[a:b].tolist())) == (features(texts[d])[0], Counter(features(texts[d])[1]))


def test_drawn_documents_keep_their_columns(spark, docs):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    out = target_resampling.drawn_documents(docs, items, percent=10)
    want = {r["doc_id"] for r in target_resampling.resample(docs, items, percent=10).where("rank is not null").collect()}
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == want


def near(rows_, n, percent):
    return Counter({(d, k, c, d == c): m for (d, k, c), m in brute.components(rows_, n, percent).items()})


def test_bottom_sketches(corpus):
    assert rows(bottom_sketches.near_duplicates(corpus, 2, 80)) == near(pairs(corpus), 2, 80)


@pytest.mark.parametrize(("n", "percent"), [(5, 80), (3, 90)])
def test_bottom_sketches_of_other_shingles(hard, n, percent):
    assert rows(bottom_sketches.near_duplicates(hard, n, percent)) == near(pairs(hard), n, percent)


def test_bottom_sketches_of_short_texts(spark):
    """Every set of up to nine shingles, with one, two or no others: lists of short runs find all links."""
    draw = random.Random(4)
    made = []
    for size in range(2, 16):
        base = [f"t{size}w{i}" for i in range(size)]
        made += [base, base[:-1], base[1:], base[:-2], [*base, "x"], ["x", *base], base[: size // 2] + ["y"] + base[size // 2 :]]
        made += [draw.sample(base, size) for _ in range(3)]
    made = [(i, " ".join(w)) for i, w in enumerate(made)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    for n, percent in ((1, 80), (2, 80)):
        assert rows(bottom_sketches.near_duplicates(df, n, percent)) == near(made, n, percent)


def test_bottom_sketches_of_large_groups(spark, monkeypatch):
    """Near copies by the hundred, pairs that only others connect, and texts that share most words without a link."""
    monkeypatch.setattr(bottom_sketches, "TILE", 16)
    monkeypatch.setattr(bottom_sketches, "LOAD", 2000)
    monkeypatch.setattr(skew, "FLOOR", 50)
    draw = random.Random(7)
    base, passage = brute.sentence(9, 400).split(), brute.sentence(3, 160).split()
    made = []
    for i in range(150):
        w = list(base)
        for k in range(draw.randrange(30)):
            w[draw.randrange(400)] = f"new{i}_{k}"
        made.append(w)
    for i in range(60):  # 60 % of the shingles are those of the passage
        made.append([f"own{i}_{k}" for k in range(90)] + passage)
    chain = brute.sentence(5, 300).split()
    for i in range(60):  # each links with its neighbours alone
        chain = chain[12:] + [f"step{i}_{k}" for k in range(12)]
        made.append(chain)
    draw.shuffle(made)
    made = [(i, " ".join(w)) for i, w in enumerate(made)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    assert rows(bottom_sketches.near_duplicates(df, 2, 80)) == near(made, 2, 80)


def test_common_runs_of_unlike_texts_fill_no_tiles(spark, monkeypatch):
    """Texts that share runs of common values by chance, and nothing else, are no candidates of each other."""
    monkeypatch.setattr(bottom_sketches, "TILE", 16)
    tiled, plain = [], bottom_sketches._tiles
    monkeypatch.setattr(bottom_sketches, "_tiles", lambda lists, percent: tiled.append(lists.select("node").distinct().count()) or plain(lists, percent))
    passage = brute.sentence(3, 40).split()
    made = [(i, " ".join([*(f"own{i}_{k}" for k in range(70)), *passage])) for i in range(120)]
    made += [(200 + i, " ".join([*(f"own{i}_{k}" for k in range(70)), *passage, f"end{i}"])) for i in range(0, 120, 10)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    assert rows(bottom_sketches.near_duplicates(df, 2, 80)) == near(made, 2, 80)
    assert sum(tiled) <= 30


@pytest.mark.parametrize(("short", "size"), [(1, 4096), (4, 16), (1000, 16)])
def test_rare_values_find_what_runs_find(spark, monkeypatch, short, size):
    """The same links by tiles of common values alone, by pairs of rare ones, and by both."""
    for name, value in (("SHORT", short), ("BIN", size), ("TILE", 16)):
        monkeypatch.setattr(bottom_sketches, name, value)
    draw, made = random.Random(4), []
    for c in range(6):
        base = brute.sentence(c, draw.choice([12, 60, 200])).split()
        for i in range(25):
            w = list(base)
            for k in range(draw.randrange(1 + len(w) // 9)):
                w[draw.randrange(len(w))] = f"new{i % 9}_{k}"
            made.append((len(made), " ".join(w)))
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    assert rows(bottom_sketches.near_duplicates(df, 2, 80)) == near(made, 2, 80)


def test_links_share_one_of_their_rarest_values(spark):
    """For any grades, two sketches with as many common values as a link has share a chosen one."""
    draw = np.random.default_rng(6)
    k, percent, least = 64, 80, bottom_sketches.least_common(80, 64)
    pool = draw.integers(0, 1 << 62, 90).astype(np.uint64)
    sizes = [4, 5, 9, 40, 64, 64, 64, 64] * 12
    sketches = [np.sort(draw.choice(pool[: max(s, 3 * s // 2)], s, replace=False)) for s in sizes]
    table = pa.table({"node": range(len(sizes)), "n": [s if s < 64 else int(draw.integers(64, 90)) for s in sizes], "component": range(len(sizes)), "sketch": [x.tobytes() for x in sketches]})
    members = exchange.materialise(spark.createDataFrame(table.to_pandas()), "members")
    grades, bits = bottom_sketches._grades(members, k)
    counts = Counter(v for x in sketches for v in x.tolist())
    grade = dict(zip(counts, grades.value[bottom_sketches._cells([np.array(list(counts), dtype=np.uint64).tobytes()], bits)].tolist(), strict=True))
    assert all(grade[v] >= math.floor(8 * math.log2(m)) for v, m in counts.items())
    chosen = defaultdict(set)
    for batch in bottom_sketches._rarest(table.to_batches(), k, percent, least, grades, bits):
        for v, i in zip(batch.column("list").to_pylist(), batch.column("node").to_pylist(), strict=True):
            chosen[i].add(v)
    n, met = table.column("n").to_pylist(), 0
    for i in range(len(sizes)):
        for j in range(i):
            if len(np.intersect1d(sketches[i], sketches[j])) >= min(least, -(-percent * max(n[i], n[j]) // 100)):
                met += 1
                assert chosen[i] & chosen[j], (i, j)
    assert met > 100


def test_lists_of_one_document_meet_no_join(spark):
    """Of 20,000 lists of one document nearly none is left, of lists of several documents none is lost."""
    made = spark.range(20_000).selectExpr("xxhash64(id) AS list", "id AS node", "id AS n").unionByName(spark.range(600).selectExpr("xxhash64(id % 200, 1) AS list", "id AS node", "id AS n"))
    postings = exchange.materialise(made, "postings")
    firsts = exchange.materialise(postings.groupBy("list").count().where("count > 1").select("list"), "firsts")
    left = bottom_sketches._of_several(postings, firsts)
    assert left.join(firsts, "list", "left_semi").count() == 600
    assert left.count() < 700


def test_hot_lists_meet_no_filtering_join(spark, monkeypatch):
    """Postings of near copies are neither set apart by joins nor labelled more than once."""
    monkeypatch.setattr(skew, "FLOOR", 50)
    plans, plain = {}, exchange.materialise
    monkeypatch.setattr(exchange, "materialise", lambda df, name: plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df, name))
    draw, base = random.Random(2), brute.sentence(9, 300).split()
    made = []
    for i in range(60):
        w = list(base)
        for k in range(draw.randrange(25)):
            w[draw.randrange(300)] = f"new{i}_{k}"
        made.append((i, " ".join(w)))
    made += [(100 + i, brute.sentence(100 + i, 80)) for i in range(30)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(bottom_sketches.near_duplicates(df, 2, 80)) == near(made, 2, 80)
    for name in ("lists", "mixed", "several"):
        assert not any(kind in plan for plan in plans.get(name, []) for kind in ("LeftAnti", "LeftSemi", "LeftOuter")), name
    assert "lists" in plans and "several" in plans and "held" not in plans


def test_postings_of_hot_lists_know_their_least(spark):
    made = spark.range(30_000).selectExpr("xxhash64(id % 3) AS list", "id + 5 AS node", "id AS n").unionByName(spark.range(4_000).selectExpr("xxhash64(id % 2000, 1) AS list", "id AS node", "id AS n"))
    postings = exchange.materialise(made, "postings")
    firsts = exchange.materialise(postings.groupBy("list").agg(F.min("node").alias("least"), F.count("*").alias("m")), "firsts")
    hot = skew.heaviest(firsts, "m")
    assert sorted((r["least"], r["m"]) for r in hot) == [(5, 10_000), (6, 10_000), (7, 10_000)]
    found = exchange.materialise(bottom_sketches._of_several(postings, firsts, hot), "near")
    assert rows(found.where("m is not null").groupBy("least", "m").count()) == Counter([(5, 10_000, 10_000), (6, 10_000, 10_000), (7, 10_000, 10_000)])
    assert found.where("m is not null and pmod(node - 5, 3) <> least - 5").isEmpty()
    assert found.where("m is null and least is null").count() == 4_000


@pytest.mark.parametrize("floor", [20_000, 50])
def test_components_read_joined_edges_once(spark, monkeypatch, floor):
    """Chains, hubs and cliques of any order of ids, and how many edges the rounds after the first one read."""
    monkeypatch.setattr(skew, "FLOOR", floor)
    stored, draw = {}, random.Random(3)
    plain = components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: stored.setdefault(name, []).append(out := plain(df, name)) or out)
    monkeypatch.setattr(components, "discard", lambda df: None)
    edges = [(i, i + 1) for i in range(100)] + [(999, 1000 + i) for i in range(100)] + [(5000, 4000 + i) for i in range(60)] + [(2000 + i, 2000 + j) for i in range(40) for j in range(i)]
    edges += [(6000 + draw.randrange(300), 6000 + draw.randrange(300)) for _ in range(250)] + [(3, 3), (None, 4), (50, 999)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    assert rows(components.components(df)) == Counter((x, find(x)) for x in root)
    first, *later = [t.count() for t in stored["edges"]]
    assert sum(later) < first / 4


def test_limits_of_sketches():
    assert bottom_sketches.longest_run(80, 64) == 3
    assert list(bottom_sketches.run_lengths(5, 80)) == [2, 3] and list(bottom_sketches.run_lengths(6, 80)) == [3]
    t = bottom_sketches.least_common(80, 64)
    below = sum(math.comb(64, k) * 0.8**k * 0.2 ** (64 - k) for k in range(t))
    assert below <= bottom_sketches.MISS < below + math.comb(64, t) * 0.8**t * 0.2 ** (64 - t)
    with pytest.raises(ValueError):
        bottom_sketches.longest_run(80, 8)


def variants(rows_, least_length=6, least_count=5, factor=5, modulus=199):
    import re

    counts = Counter()
    for d, t in rows_:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(brute.LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % modulus == 0 else w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_length and c >= least_count}
    gaps = defaultdict(set)  # words by what is left without one of their letters, or with one blanked
    for w in n:
        for i in range(len(w)):
            gaps[w[:i] + w[i + 1 :]].add(w)
            gaps[w[:i] + "\0" + w[i + 1 :]].add(w)
    close = {w: set() for w in n}
    for key, ws in gaps.items():
        if key in n:
            for w in ws:
                close[w].add(key)
                close[key].add(w)
        if "\0" in key:
            for w in ws:
                close[w] |= ws - {w}
    form = {}
    for w, near_ in close.items():
        if near_ and n[best := min(near_, key=lambda x: (-n[x], x))] >= factor * n[w]:
            form[w] = best
    out = Counter()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w, form.get(w), root, n[w], len(close[w]), n[form[w]] if w in form else None] += 1
    return out


def test_spelling_variants(corpus):
    got = spelling_variants.group_variants(corpus)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows(got) == variants(pairs(corpus))


def test_spelling_variants_of_chains_and_doubled_letters(spark, monkeypatch):
    monkeypatch.setattr(skew, "FLOOR", 3)
    words = {"balloon": 3200, "baloon": 500, "balooon": 90, "baloooon": 15, "ballon": 600, "ÿéßàüö": 40, "ÿéßàü÷": 7, "ÿéßàüöx": 5, "BALLOON": 10, "aaaaaa": 30, "aaaaaaa": 6, "aaaaaab": 5, "kitten": 4, "mitten": 5}
    text = [w for w, k in words.items() for _ in range(k)]
    made = [(i, " ".join(text[i::40])) for i in range(40)] + [(None, "balloon, kitten-mitten 4balloon4")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    for modulus in (199, 3):
        assert rows(spelling_variants.group_variants(df, modulus=modulus)) == variants(made, modulus=modulus)


def test_neighbours_are_distinct_and_complete():
    """Hashes of all three kinds against sets of strings."""
    alphabet = "abé"
    for word in ("aab", "abba", "ééa", "b"):
        points, letters = spelling_variants._matrix([word]), spelling_variants._matrix([alphabet])[0]
        for kind in ("deletion", "replacement", "insertion"):
            h, fresh = spelling_variants.neighbours(points, letters, kind)
            spelled = [spelling_variants._spelled(word, p, alphabet[c], kind) for _, p, c in zip(*np.nonzero(fresh), strict=True)]
            if kind == "deletion":
                want = {word[:i] + word[i + 1 :] for i in range(len(word))}
            elif kind == "replacement":
                want = {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet} - {word}
            else:
                want = {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}
            assert sorted(spelled) == sorted(want)
            whole = [int(spelling_variants._sums(spelling_variants._matrix([x]))[0][0, -1]) if x else 0 for x in spelled]
            assert h[fresh].tolist() == whole
