"""Similar texts by wide fingerprints, and the near stage of the pipeline, against brute-force Jaccard."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dramatis.llm import simhash
from tests.llm.test_ops import brute_fingerprint

ROW = "doc_id long, text string"


def brute_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_groups(rows):
    """The least id of each row's component, by id."""
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {rows[k][0]: rows[find(k)][0] for k in range(len(rows))}


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def pairs_of(groups):
    """Pairs of ids that are in one group."""
    members = {}
    for i, root in groups.items():
        members.setdefault(root, []).append(i)
    return {p for own in members.values() for p in combinations(sorted(own), 2)}


@pytest.mark.parametrize("bucket", [4, 30, simhash.BUCKET])
def test_similar_groups(spark, bucket):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    line = rng.choices(vocabulary, k=20)  # in most texts
    texts = [None, "", "\n", "one two", "ONE  two", "a b c d e", "a b c d e f", "a b c d e f"]
    for k in range(12):
        base = rng.choices(vocabulary, k=rng.choice([30, 100, 250])) + line
        texts += [edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 4, 6])) for _ in range(12)]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, ROW).withColumn("node", F.lit("x")).withColumn("label", F.lit(1))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(frame, bucket=bucket).collect()}
    want = pairs_of(brute_groups(rows))
    found = pairs_of(got)
    assert found <= want and len(found) >= 0.95 * len(want) > 100
    assert all(len({got[k] for k in same}) == 1 for same in ([0, 1, 2], [3, 4], [6, 7]))
    assert simhash.similar_groups(spark.createDataFrame([], ROW), bucket=bucket).count() == 0


def test_recall_of_planted_copies(spark):
    """Copies of whole documents edited down to a similarity of 0.8."""
    rng = random.Random(11)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) between 200 and 20000").orderBy("doc_id").limit(400).collect()]
    planted = []
    for i, text in rows:
        words = text.split()
        for k in range(2):
            copy = edited(rng, words, rng.randint(1, max(1, len(words) // 40)))
            one, other = brute_set(text), brute_set(copy)
            if 5 * len(one & other) >= 4 * len(one | other):
                planted.append((i, 1_000_000 + 10 * i + k, copy))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows + [x[1:] for x in planted], ROW).repartition(4)).collect()}
    recall = np.mean([got[a] == got[b] for a, b, _ in planted])
    assert len(planted) > 300 and recall >= 0.95


def test_masks_of_a_block():
    """Every set of BLOCK_RADIUS bits is left out by some mask."""
    n, radius = simhash.BLOCK_BITS, simhash.BLOCK_RADIUS
    masks = simhash.covering_masks((1 << n) - 1, radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    assert all(any(not some & m for m in masks) for some in (sum(1 << b for b in c) for c in combinations(range(n), radius)))


def test_near_stage_reaches_similarity(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(120)]
    near = [(k, edited(rng, words, 1)) for k in range(2)]
    rows = [*near, (5, " ".join(rng.sample(words, 120)))]
    assert (brute_fingerprint(rows[0][1]) ^ brute_fingerprint(rows[1][1])).bit_count() > 2
    assert brute_groups(rows) == {0: 0, 1: 0, 5: 5}
    assert {r.doc_id for r in corpus_pipeline.near(spark, spark.createDataFrame(rows, ROW), "").collect()} == {0, 5}


def test_repeated_ids(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(120)]
    a, b = " ".join(words), " ".join(rng.sample(words, 120))
    frame = lambda rows: spark.createDataFrame(rows, ROW)
    rows = lambda out: sorted((r.doc_id, r.text) for r in out.collect())
    # (5, a) goes for (9, a) although (5, b) stays; of the row (9, a) ingested twice one stays.
    assert rows(corpus_pipeline.exact(spark, frame([(5, a), (5, b), (9, a), (9, a), (1, a)]), "")) == sorted([(5, b), (9, a)])
    assert {(r.doc_id, r.text) for r in corpus_pipeline.exact(spark, frame([(None, a), (None, a), (None, b), (3, b)]), "").collect()} == {(None, a), (3, b)}
    # (5, a) goes for (2, near a); (5, b) stays once, and of the near copies (7, c) and (7, near c) one stays.
    c = " ".join(f"x{k}" for k in range(120))
    near_a, near_c = (edited(rng, t.split(), 1) for t in (a, c))
    out = rows(corpus_pipeline.near(spark, frame([(5, a), (2, near_a), (5, b), (5, b), (7, c), (7, near_c)]), ""))
    assert len(out) == 3 and out[:2] == [(2, near_a), (5, b)] and out[2] in [(7, c), (7, near_c)]


@pytest.mark.parametrize("bucket", [4, simhash.BUCKET])
def test_no_similar_pair_is_left_out(spark, bucket):
    """Chains at the very threshold, texts of few shingles, and a common line: the same groups as brute force, to the last link."""
    rng = random.Random(13)
    vocabulary = [f"v{k}" for k in range(300)]
    line = rng.choices(vocabulary, k=15)
    texts = []
    for size in [5, 6, 8, 10, 12, 14, 20, 30, 45, 60, 90, 150] * 4:
        words = rng.choices(vocabulary, k=size) + line[: rng.choice([0, 15])]
        for _ in range(6):  # each from the one before it
            cut = rng.randint(0, max(1, len(words) // 4))
            words = words[cut:] if rng.random() < 0.5 else [*rng.choices(vocabulary, k=cut), *words]
            texts.append(" ".join(words))
    rows = list(enumerate(texts))
    want = brute_groups(rows)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, ROW), bucket=bucket).collect()}
    assert got == want and 70 < len(set(want.values())) < 0.8 * len(rows)


def test_exact_pass_alone(spark, monkeypatch):
    """The same groups if the fingerprints find no candidate at all, on documents with planted copies."""
    monkeypatch.setattr(simhash, "ALL_FAR", -1)
    rng = random.Random(17)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) between 200 and 8000").orderBy("doc_id").limit(120).collect()]
    for i, text in list(rows):
        words = text.split()
        rows += [(1_000_000 + 10 * i + k, edited(rng, words, rng.randint(1, max(1, len(words) // 35)))) for k in range(2)]
    want = brute_groups(rows)
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, ROW).repartition(4)).collect()} == want
    assert len(set(want.values())) < 0.7 * len(rows)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 500, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for n in (1, 3, 40, 200, 400, 2000)] + [np.zeros(0, np.uint64)]
    bits = simhash.parities(sets)
    assert bits.shape == (7, simhash.PARITY_BITS // 64) and not bits[-1].any()
    for i, j in combinations(range(7), 2):
        assert int(np.bitwise_count(bits[i] ^ bits[j]).sum()) <= len(np.setxor1d(sets[i], sets[j]))


def test_wide_parities_bound_the_difference():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (2048, 2049, 4096, 4097, 4600, 20_000)]
    sets += [np.unique(np.concatenate([s[: len(s) - k], rng.integers(0, 1 << 63, k).astype(np.uint64)])) for s in sets for k in (1, 300)]
    bits = [simhash.wide_parities(s) for s in sets]
    assert [64 * len(x) for x in bits[:6]] == [0, 2048, 2048, 4096, 4096, 16_384]
    for i, j in combinations([k for k in range(len(sets)) if len(bits[k])], 2):
        apart = len(np.setxor1d(sets[i], sets[j]))
        got = simhash.differing_parities(bits[i], bits[j])
        assert got == simhash.differing_parities(bits[j], bits[i]) <= apart and (apart > 10 or got == apart)


def test_long_dissimilar_texts_are_not_checked_by_their_sets(spark, monkeypatch):
    """Of long texts that share a passage, the sets are not moved; long similar ones, of one width of parities or two, are linked."""
    monkeypatch.setattr(simhash, "ALL_FAR", -1)
    rng, texts = random.Random(23), []
    fresh = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    for _ in range(6):
        passage = fresh(1500)
        texts += [" ".join(fresh(3500) + passage), " ".join(passage + fresh(3500))]
    words, longer = fresh(5000), fresh(4600)
    similar = [" ".join(words), edited(rng, words, 80), " ".join(longer), " ".join(longer[:4000])]
    rows = list(enumerate(texts + similar))
    kept, keep = {}, simhash.Scratch.keep

    def noted(self, df, name):
        out = keep(self, df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(simhash.Scratch, "keep", noted)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, ROW), bucket=4).collect()}
    assert got == brute_groups(rows) == {**{k: k for k, _ in rows}, 13: 12, 15: 14}
    assert kept["pairs_second"] == 8 and kept["sets_second"] == 4


@pytest.mark.parametrize("most", [3, 40, simhash.FOREST_LINKS])
def test_forest_connects_the_same(spark, most):
    rng = random.Random(29)
    links = [(a, b) for at in (0, 100, 200) for a, b in combinations(range(at, at + 30), 2) if rng.random() < 0.3] + [(-5, 150), (150, 151), (400, 401)]
    scratch = simhash.Scratch(spark, "forest")
    frame = scratch.keep(spark.createDataFrame(links, "a long, b long"), "links")
    out = simhash.forest(frame, scratch, "forest", most)
    groups = lambda df, to: {r.node: r.label for r in simhash.components(df, simhash.Scratch(spark, to)).collect()}
    assert groups(out, "reduced") == groups(frame, "all") and out.count() <= len(links)
    assert most < 100 or out.count() == 3 * 29 + 3
    assert simhash.forest(frame.limit(0), scratch, "none", most).count() == 0


def test_links_of_a_large_group_are_few(spark, monkeypatch):
    """Near copies of one text meet in many buckets, yet the components are found over at most a link for each."""
    rng, kept, keep = random.Random(31), {}, simhash.Scratch.keep
    words = [f"g{k}" for k in range(150)]
    rows = [(k, edited(rng, words, 1)) for k in range(80)]

    def noted(self, df, name):
        out = keep(self, df, name)
        kept.setdefault(name, out.count())
        return out

    monkeypatch.setattr(simhash.Scratch, "keep", noted)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, ROW)).collect()}
    assert got == brute_groups(rows) and set(got.values()) == {0}
    assert kept["links_first"] > 2 * len(rows) and kept["both"] <= 2 * (len(rows) - 1)
