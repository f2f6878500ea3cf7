"""The multi-index Hamming join and the resolver of lists against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import minhash_join, ngram_join, queries, set_links
from tests.llm.test_llm import SCHEMA, assert_components, corpus, shingle_set

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("k", "percent"), [(2, 80), (3, 90)])
def test_components_match_brute_force(spark, k, percent):
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    own = docs.filter("doc_id is not null")
    assert_components(own, minhash_join.components(own, minhash_join.shingles(k), percent), lambda t: shingle_set(t, k), percent)
    assert minhash_join.components(docs, minhash_join.shingles(k), percent).count() == docs.count()


def test_no_rows_and_refused_thresholds(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash_join.components(empty, minhash_join.shingles(2), 80).count() == 0
    with pytest.raises(ValueError, match="miss"):
        minhash_join.components(empty, minhash_join.shingles(2), 60)


def test_query_over_documents(spark):
    found = queries.op13_minhash_hamming(spark, SMALL)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    as_found = found.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.col("component_id").alias("component"))
    assert_components(docs, as_found, lambda t: shingle_set(t, 2), 80)
    assert found.filter("kept <> (doc_id = component_id)").count() == 0


def test_every_pair_under_the_distance_shares_a_key(monkeypatch):
    rng = np.random.default_rng(2)
    values = {}
    monkeypatch.setattr(minhash_join, "symbols", lambda members: values[int(members[0])])
    for _ in range(300):
        values[0] = rng.integers(0, 1 << 16, minhash_join.VALUES, dtype=np.uint16)
        values[1] = values[0].copy()
        at = rng.permutation(minhash_join.VALUES)[: rng.integers(0, minhash_join.DISTANCE + 1)]
        values[1][at] ^= rng.integers(1, 1 << 16, len(at), dtype=np.uint16)
        a, b = (set(minhash_join.chunk_keys(np.array([i], np.uint64)).tolist()) for i in (0, 1))
        assert a & b
    # The least friendly case: one error more in all chunks but one.
    values[1] = values[0].copy().reshape(minhash_join.CHUNKS, minhash_join.WIDTH)
    values[1][:-1, :2] ^= 1
    values[1][-1, 0] ^= 1
    values[1] = values[1].ravel()
    a, b = (set(minhash_join.chunk_keys(np.array([i], np.uint64)).tolist()) for i in (0, 1))
    assert len(a & b) == 1


def test_distances_in_columns(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(60):
        a = rng.integers(0, 1 << 16, minhash_join.VALUES, dtype=np.uint16)
        b = np.where(rng.random(len(a)) < i / 60, a ^ (1 << rng.integers(0, 16, len(a), dtype=np.uint16)), a).astype(np.uint16)
        rows.append((int((a != b).sum()), a.view(np.int64).tolist(), b.view(np.int64).tolist()))
    df = spark.createDataFrame(rows, "d long, x array<long>, y array<long>")
    assert df.filter(minhash_join.differing(F.col("x"), F.col("y")) != F.col("d")).count() == 0


def test_estimates_follow_similarity():
    rng = np.random.default_rng(8)
    far = []
    for _ in range(100):
        x = rng.permutation(np.unique(rng.integers(0, 1 << 63, 889, dtype=np.uint64)))
        a, b = np.sort(x[:800]), np.sort(np.concatenate([x[:711], x[800:889]]))
        far.append(int((minhash_join.symbols(a) != minhash_join.symbols(b)).sum()))
    assert 30 < np.mean(far) < 35 and max(far) <= minhash_join.DISTANCE


def families(spark, n, seed):
    """A passage in most texts with few own words, so that similarities straddle the threshold; two passages in some."""
    random.seed(seed)
    one, two = [f"p{i}" for i in range(60)], [f"q{i}" for i in range(25)]
    rows = []
    for i in range(n):
        own = [f"u{i if i % 7 else i // 14}_{j}" for j in range(random.choice([2, 4, 8, 9, 10, 14]))]
        at = random.randrange(len(own))
        rows.append((i, " ".join(own[:at] + one + (two if i % 3 == 0 else []) + own[at:])))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("join", [ngram_join, minhash_join])
@pytest.mark.parametrize(("k", "percent", "crowd"), [(2, 80, 2), (3, 90, 2), (3, 90, 8)])
def test_shared_passages_on_crowded_lists(spark, monkeypatch, join, k, percent, crowd):
    monkeypatch.setattr(set_links, "CROWD", crowd)
    docs = families(spark, 90, crowd)
    assert_components(docs, join.components(docs, join.shingles(k), percent), lambda t: shingle_set(t, k), percent)


def test_ids_are_drawn_again_where_sets_share_one(spark, monkeypatch):
    real = set_links.set_id
    # Under the first seed all sets share one id.
    monkeypatch.setattr(set_links, "set_id", lambda members, seed=0: 5 if seed == 0 else real(members, seed))
    docs = families(spark, 20, 1)
    source = docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("print"))
    rows, seed = set_links.identified(source, set_links.shingles(2))
    assert seed == 2 and rows.select("sid").distinct().count() == rows.select("second").distinct().count()


@pytest.mark.parametrize("most", [500_000, 7])
def test_components_of_links(spark, monkeypatch, most):
    monkeypatch.setattr(set_links, "TASK_LINKS", most)
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5)]
    root = {n: n for link in links for n in link}
    for _ in range(200):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = set_links.connected(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {n: r for n, r in root.items() if any(a != b and n in (a, b) for a, b in links)}
    assert set_links.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_crowded_sets_far_apart_are_not_compared(spark, monkeypatch):
    """Of sets that share a passage only, no differences are shipped; they used to be, for each set and leader."""
    monkeypatch.setattr(set_links, "CROWD", 4)
    compared, dealt = [], []
    real_answer, real_lead = set_links.Resolver.answer, set_links.Resolver.lead

    def answer(self, pairs, *more, **named):
        compared.append(pairs.count())
        return real_answer(self, pairs, *more, **named)

    def lead(self, lists):
        dealt.append(lists.count())
        return real_lead(self, lists)

    monkeypatch.setattr(set_links.Resolver, "answer", answer)
    monkeypatch.setattr(set_links.Resolver, "lead", lead)
    rows = [(i, " ".join([f"p{j}" for j in range(60)] + [f"u{i}_{j}" for j in range(12)])) for i in range(60)]
    found = ngram_join.components(spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.shingles(3), 90)
    assert found.filter("id <> component").count() == 0
    assert dealt and sum(compared) == 0
