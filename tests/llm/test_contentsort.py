from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quintil.llm import contentsort


def expected(rows, keep, normal=lambda t: t):
    groups = defaultdict(list)
    for key, text in rows:
        groups[normal(text or "")].append(key)
    found = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = None if not known else min(known) if keep == "smallest" else max(known)
        marked = False
        for i in sorted(ids, key=lambda x: (x is None, x)):
            kept = i == best and not marked
            marked |= kept
            found.append((i, best, len(ids), kept, sha256(text.encode()).hexdigest()))
    return sorted(found, key=str)


def marked(frame, **options):
    return sorted((tuple(r) for r in contentsort.mark_copies(frame, **options).collect()), key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_marks_follow_brute_force(docs, corpus, keep):
    assert marked(docs, keep=keep) == expected([r[:2] for r in corpus], keep)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_hot_groups_are_split_and_put_together(spark, keep):
    rows = [(i, "the same beginning of every text " * 20) for i in range(400)]
    rows += [(1000 + i, "the same beginning of every text " + str(i % 150)) for i in range(300)]
    rows += [(None, "the same beginning of every text " * 20)] * 3 + [(7, "the same beginning of every text " * 20)] * 2
    rows += [(5000, "x" * 200_000), (5001, "x" * 200_000), (5002, "x" * 200_000 + "y"), (5003, None), (5004, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert marked(frame, keep=keep) == expected(rows, keep)


def test_only_nameless_copies_keep_one(spark):
    frame = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b")], "doc_id long, text string")
    assert sum(r.kept for r in contentsort.mark_copies(frame).collect()) == 2


def test_normalised_contents_meet(spark, corpus):
    rows = [(i, t.upper() if t and i and i % 2 else t) for i, t, *_ in corpus]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert marked(frame, normalise=F.lower) == expected(rows, "smallest", str.lower)


def test_dropped_copies_leave_rows_as_they_were(spark):
    rows = [(1, "a", 5, "x"), (2, "a", 6, None), (3, "b", 7, "y"), (3, "b", 7, "y")]
    frame = spark.createDataFrame(rows, "doc_id int, t string, h int, rest string")
    kept = contentsort.drop_copies(frame, text="t", keep="largest")
    assert kept.columns == frame.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(2, "a", 6, None), (3, "b", 7, "y")]


def test_empty_table(none):
    assert contentsort.mark_copies(none).count() == 0
    assert contentsort.drop_copies(none).count() == 0


def test_unknown_keep(docs):
    with pytest.raises(ValueError, match="smallest or largest"):
        contentsort.mark_copies(docs, keep="first")
