import random

import pytest
from test_text_operators import lower, words

import corpus_pipeline
from quintil import session
from quintil.llm import components, similar


def shingles(text):
    w = words(lower(text))
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_first(rows):
    """Smallest ids of the components of all pairs with a similarity of 0.8 or more."""
    sets, least = [(i, shingles(t)) for i, t in rows], {}
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, s) in enumerate(sets):
        for b, (_, u) in enumerate(sets[:a]):
            if s == u or 5 * len(s & u) >= 4 * len(s | u):
                parent[root(a)] = root(b)
    for x, (i, _) in enumerate(sets):
        least[root(x)] = min(i, least.get(root(x), i))
    return set(least.values())


def edited(rng, text, n):
    w = text.split(" ")
    for at in rng.sample(range(len(w)), n):
        w[at] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def documents():
    rng = random.Random(5)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    rows = []
    for n in (40, 120, 300, 900):
        for _ in range(12):
            base = fresh(n)
            rows += [base, base.upper(), *(edited(rng, base, k) for k in {1, n // 60, n // 40, n // 20})]
    chain = fresh(200)
    for _ in range(12):  # ends apart, linked by the steps between
        rows.append(chain)
        chain = edited(rng, chain, 3)
    line = fresh(30)
    rows += [f"{line} {fresh(20)}" for _ in range(40)]  # alike, but below 0.8
    rows += ["", None, " \n", "a b", "A  b", "a b c", "a b c d e"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_dedup_against_all_pairs(spark):
    rows = documents()
    docs = spark.createDataFrame([*rows, (None, "a b")], "doc_id long, text string").repartition(3)
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(kept, key=repr) == sorted([*brute_first(rows), None], key=repr)


@pytest.mark.parametrize("rounds", [0, 2])
def test_near_dedup_by_prefixes_after_fewer_rounds(spark, monkeypatch, rounds):
    monkeypatch.setattr(similar, "ROUNDS", rounds)
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.key for r in similar.first_of_each(docs).collect()} == brute_first(rows)


def test_near_dedup_runs_the_fingerprint_operator(spark, monkeypatch):
    """The operator of fuzzy SimHash names pairs, all of them right ones once checked, before any band is read."""
    seen = []
    pairs_of = similar.fingerprint_pairs

    def kept(*args):
        seen.append(pairs_of(*args))
        return seen[-1]

    monkeypatch.setattr(similar, "fingerprint_pairs", kept)
    monkeypatch.setattr(similar, "_link", lambda members, sets, roots: roots)
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = {r.key for r in similar.first_of_each(docs).collect()}
    assert len(seen) == 1 and seen[0].count() > 0
    alone = len({shingles(t) for _, t in rows})
    assert brute_first(rows) <= first and len(brute_first(rows)) < len(first) < alone


def edges_of_paths():
    return [(b * 100 + i, b * 100 + i + 1) for b in range(20) for i in range(12)] + [(7, 7), (3, None)]


@pytest.mark.parametrize("rows", [50, 200_000])
def test_components_lie_in_the_partitions_that_their_edges_ask_for(spark, monkeypatch, rows):
    """Small rounds do not take a file for each partition of the session and each shuffle."""
    monkeypatch.setattr(session, "PARTITION_ROWS", rows)
    conf = {"spark.sql.shuffle.partitions": "31", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        edges = spark.createDataFrame(edges_of_paths(), "a long, b long")
        found = components.smallest_reachable(edges)
        assert {tuple(r) for r in found.collect()} == {(b * 100 + i, b * 100) for b in range(20) for i in range(1, 13)}
        assert found.rdd.getNumPartitions() == (5 if rows == 50 else 1)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
