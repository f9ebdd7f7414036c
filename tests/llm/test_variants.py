import random
from itertools import combinations
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quintil.llm import variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def expected(counts, ratio):
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o.encode()), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    rows = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return sorted(rows)


def test_groups_follow_brute_force(spark):
    rng = random.Random(5)
    counts = {}
    for letters, number in (("ab", 60), ("abcdé", 300), ("aaaab", 60)):
        for _ in range(number):
            counts["".join(rng.choice(letters) for _ in range(rng.randint(4, 9)))] = int(5 * 6 ** (4 * rng.random()))
    counts |= {"é" * 50: 5, "é" * 49: 30, "x" * 3000: 5, "x" * 1500 + "y" + "x" * 1499: 100}
    frame = spark.createDataFrame([*counts.items(), (None, 4), ("abab", None)], "word string, n long").repartition(3)
    found = sorted(tuple(r) for r in variants.group_variants(frame, 5).collect())
    assert found == expected(counts, 5)


def test_long_chain_of_forms(spark):
    counts = {"a" * i + "b" * (12 - i): 3**i for i in range(13)}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = sorted(tuple(r) for r in variants.group_variants(frame, 3).collect())
    assert found == expected(counts, 3)
    assert {r[2] for r in found} == {"a" * 12}


def test_repeated_words_add_up(spark):
    frame = spark.createDataFrame([("abcdef", 3, "x"), ("abcdef", 4, "y"), ("abcdeg", 40, "z")], "word string, n long, form string")
    found = {r.word: tuple(r) for r in variants.group_variants(frame).collect()}
    assert found["abcdef"] == ("abcdef", "abcdeg", "abcdeg", 7, 1, 40)


@given(st.sets(st.integers(0, 30), min_size=3, max_size=12), st.randoms())
def test_pivots_are_the_lightest_disjoint_pair(places, rng):
    instances = [(p, rng.randint(1, 9)) for p in sorted(places)]
    weights = dict(instances)
    pairs = [(a, b) for a, b in combinations(sorted(places), 2) if b - a >= 2]
    chosen = variants.pivots(instances)
    assert chosen[1] - chosen[0] >= 2
    assert sum(weights[p] for p in chosen) == min(weights[a] + weights[b] for a, b in pairs)


@settings(max_examples=300)
@given(st.text("abcd", min_size=4, max_size=12), st.integers(0, 12), st.sampled_from("abcd"), st.sampled_from(["add", "change"]))
def test_words_one_edit_apart_meet_in_a_list(word, at, letter, kind):
    at = min(at, len(word) if kind == "add" else len(word) - 1)
    other = word[:at] + letter + word[at if kind == "add" else at + 1 :]
    counts = {x + y: ord(x) * 7 % 5 + ord(y) * 3 % 4 for x in "abcd" for y in "abcd"}
    grams = variants.Grams(counts)

    def meets(a, b):
        lists = {}
        for k, first, last in grams.listed(b):
            lists.setdefault(k, []).append((first, last))
        return any(f <= last and first <= t for k, f, t in grams.looked_up(a) for first, last in lists.get(k, []))

    assert word == other or meets(word, other) or meets(other, word)


def test_damage_is_that_of_crc32(spark):
    rows = [(i, w) for i in [*range(400), None] for w in ("recorder", "é", "naïve")]
    frame = spark.createDataFrame(rows, "d long, r string")
    for doc, run, got in frame.select("d", "r", variants.damaged(F.col("d"), F.col("r"), 7)).collect():
        h = crc32(f"{'null' if doc is None else doc}:{run}".encode())
        at = h % len(run)
        assert got == (run[:at] + run[at + 1 :] if h % 7 == 0 else run)


def test_runs_and_vocabulary(spark, docs, none):
    frame = spark.createDataFrame([(1, "Àbc-deF gh1i × ÷", "a"), (2, None, "b"), (None, "", "c"), (3, "DEF def", "d")], "doc_id long, text string, run string")
    found = sorted((r.run, r.doc_id) for r in variants.runs_of(frame).collect())
    assert found == [("def", 1), ("def", 3), ("def", 3), ("gh", 1), ("i", 1), ("Àbc", 1), ("×", 1), ("÷", 1)]
    words = variants.runs_of(frame).withColumnRenamed("run", "word")
    assert [tuple(r) for r in variants.vocabulary(words, 3, 2).collect()] == [("def", 3)]
    assert variants.group_variants(variants.vocabulary(variants.runs_of(none).withColumnRenamed("run", "word"), 6, 5)).count() == 0
    assert variants.runs_of(docs).count() > 0


def test_refused_parameters(spark):
    frame = spark.createDataFrame([("abc", 5)], "word string, n long")
    with pytest.raises(ValueError, match="4 code points"):
        variants.group_variants(frame)
    with pytest.raises(ValueError, match="at least twice"):
        variants.group_variants(frame, 1)
