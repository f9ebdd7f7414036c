import random
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quintil.llm import prefixtrie
from quintil.llm.queries import rebuilt
from quintil.llm.text import words_of


def sequences(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in talks.items()}


def expected(talks):
    members = defaultdict(list)
    for conv, seq in talks.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(conv)
    rows = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        inner = {p[:-1] for p in members if p}
        ends = sorted(c for c in convs if len(talks[c]) == len(path))
        saved = sum((len(members[p]) - 1) * (len(words_of(p[-1][1])) if p else 0) for p in below)
        rows.append(
            (
                min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), sum(len(p) == len(path) + 1 for p in below),
                sum(p not in inner for p in below), saved, sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(rows, key=str)


def random_rows(seed, convs=60, words=("yes", "no", "may be so", "", None)):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-20, 400), convs):
        length = rng.choice([0, 1, 2, 3, 5, 8])
        for turn in range(length):
            rows.append((conv, rng.choice([turn, turn, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(words)))
    return rows + [(None, 1, "user", "x")]


def frame_of(spark, rows):
    with_more = [(*r, "x", "y", "z") for r in rows]
    return spark.createDataFrame(with_more, "conv_id long, turn long, role string, text string, position string, node string, words string").repartition(3)


def nodes(items, ids, **options):
    found = prefixtrie.build(items, ids, **options).drop("node", "parent")
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize(("seed", "share", "limit"), [(1, None, 200_000), (2, 0, 3), (3, 2, 1), (4, 10**6, 2)])
def test_nodes_follow_brute_force(spark, seed, share, limit):
    rows = random_rows(seed)
    talks = sequences(rows)
    bare = [(c,) for c in range(1000, 1003)]
    items = prefixtrie.turn_items(frame_of(spark, rows))
    ids = spark.createDataFrame([(c,) for c in talks] + bare + bare + [(None,)], "c long")
    assert nodes(items, ids, share=share, limit=limit) == expected(talks | {c: [] for (c,) in bare})


def test_rebuilt_conversations(spark):
    rows = random_rows(9, convs=150, words=("yes", "no"))
    talks = sequences(rows)
    from zlib import crc32

    whole = {}
    for c, own in talks.items():
        h = crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = talks.get(base, [])[:h] + own[h:]
    turns, ids = rebuilt(prefixtrie.turn_items(frame_of(spark, rows)))
    assert nodes(turns, ids) == expected(whole)


def test_long_and_hot_conversations(spark):
    long = [(1, t, "user", f"turn {t % 7}") for t in range(3000)]
    rows = long + [(2, *r[1:]) for r in long[:2990]] + [(3, 0, "user", "word " * 50_000)]
    rows += [(10 + i, t, "user", f"turn {t % 7}") for i in range(300) for t in range(3)]
    found = {(r.conv_id, r.depth): r for r in prefixtrie.build(prefixtrie.turn_items(frame_of(spark, rows)), spark.createDataFrame([(c,) for c in {r[0] for r in rows}], "c long")).collect()}
    assert len(found) == 3002
    root = found[1, 0]
    assert (root.n_convs, root.n_children, root.n_leaves) == (303, 2, 2)
    assert root.saved_tokens == 2 * 3 * 301 + 2 * 2987
    assert found[1, 3].ends_sha256 == sha256(",".join(str(10 + i) for i in range(300)).encode()).hexdigest()
    assert found[1, 3000].parent_conv_id == 1 and found[1, 2990].n_convs == 2


def test_empty_table(spark):
    empty = frame_of(spark, [(1, 1, "a", "b")]).where("conv_id > 5")
    items = prefixtrie.turn_items(empty)
    assert nodes(items, items.select("conv_id")) == []
    one = spark.createDataFrame([(4,)], "c long")
    assert nodes(items, one) == [(4, 0, None, 1, 0, 1, 0, sha256(b"4").hexdigest())]


def test_places_of_turns(spark):
    rows = random_rows(6)
    found = prefixtrie.turn_items(frame_of(spark, rows)).orderBy("conv_id", "position").collect()
    talks = sequences(rows)
    assert [(r.conv_id, r.position, r.words) for r in found] == [(c, i, len(words_of(t[1]))) for c in sorted(talks) for i, t in enumerate(talks[c])]


def test_queue_gives_messages_in_order_from_runs():
    rng = random.Random(3)
    queue = prefixtrie.MessageQueue(limit=4)
    sent = [(rng.randint(-5, 0), bytes([rng.randint(0, 3)]), i, i) for i in range(200)]
    for message in sent:
        queue.push(message)
    for level, node in sorted({m[:2] for m in sent}):
        assert sorted(queue.pop_equal(level, node)) == sorted(m for m in sent if m[:2] == (level, node))
    assert not queue.heap and not queue.tops


def test_digest_tells_role_and_text_apart(spark):
    frame = frame_of(spark, [(1, 0, "a", "bc"), (2, 0, "ab", "c"), (3, 0, "", None), (4, 0, None, "")])
    items = {r.conv_id: bytes(r.item) for r in prefixtrie.turn_items(frame).select("conv_id", F.col("item")).collect()}
    assert items[1] != items[2] and items[3] == items[4]
