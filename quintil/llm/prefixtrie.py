"""Prefix trie of conversations, its subtree totals by time-forward processing.

A conversation is a sequence of turns; a turn is known by a digest of role and text. The node of its first d turns is
(d, sum of digest_i * BASE^i modulo a prime of 127 bits). Such sums add up over ranges: turns are range-partitioned by
(conversation, place), summed as they stream by, and what a conversation brings from earlier ranges is a table of one
row a range. So a conversation of any length is spread like any other. Equal nodes combine before they travel.

Totals then pass from children to parents without a tree in memory. Nodes with more than a share of the conversations
are the crown; under each place where the crown ends hangs a shard. A task streams its shards' nodes sorted by reverse
level order, keeps what is sent to parents in a priority queue in the same order, which spills sorted runs, and reads a
node's messages off its top when the node comes by. What reaches the shards' roots is added up by parent and the same
pass runs over the crown, whose levels have at most four nodes a partition each.

The ends of a node are hashed in order of their ids as they stream by, packed beforehand by range, because one hash of all
of them is asked for. Rows with a null conversation are ignored; a null role or text is empty; turns come in order of
turn (nulls first), role, text. A conversation without turns is a member of the root only.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintil.llm.text import words_column
from quintil.session import settle

PRIME = (1 << 127) - 1
BASE = 0x5851F42D4C957F2D14057B7EF767814F
ROOT = bytes(16)
HEAD = 16  # characters of role and text that take part in a splitter
HELD = 200_000  # messages in memory before a run is written
PACKED_IDS = 8192
TOTALS = ("n_children", "n_leaves", "saved_tokens")


def turn_items(talk: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, position, item, words): every turn with its place from 0, the digest of (role, text) and its word count."""
    plain = talk.select(
        talk[key].cast("long").alias("conv_id"), talk[turn].alias("t"), F.coalesce(talk[role], F.lit("")).alias("r"), F.coalesce(talk[text], F.lit("")).alias("x")
    ).where("conv_id IS NOT NULL")
    heads = [F.substring("r", 1, HEAD).alias("rh"), F.substring("x", 1, HEAD).alias("xh")]
    item = F.substring(F.unhex(F.sha2(F.concat(F.octet_length("r").cast("string"), F.lit(":"), "r", "x"), 256)), 1, 16)
    placed = plain.select("*", *heads).repartitionByRange("conv_id", "t", "rh", "xh").sortWithinPartitions("conv_id", "t", "r", "x")
    slim = placed.select("conv_id", F.monotonically_increasing_id().alias("row"), item.alias("item"), F.size(words_column(F.col("x"))).alias("words"))
    rows = settle(slim)
    first = rows.groupBy("conv_id", F.shiftright("row", 33).alias("part")).agg(F.min("row").alias("start"), F.count("*").alias("n"))
    before = F.sum("n").over(_earlier()).alias("before")
    starts = first.select("conv_id", "part", "start", F.coalesce(before, F.lit(0)).alias("before"))
    joined = rows.withColumn("part", F.shiftright("row", 33)).join(starts, ["conv_id", "part"])
    return settle(joined.select("conv_id", (F.col("before") + F.col("row") - F.col("start")).alias("position"), "item", F.col("words").cast("long").alias("words")))


def _earlier():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def _summed(items: DataFrame) -> tuple[DataFrame, dict[int, tuple[int, int]], set[int]]:
    """Sums within each range, what its first conversation brings, and the ranges whose last conversation goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, place, power = None, 0, -1, 0
        for batch in batches:
            sums, terms = [], []
            for conv, position, item in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if conv != now or position != place + 1:
                    power = pow(BASE, position, PRIME)
                    total = 0 if conv != now else total
                now, place = conv, position
                term = (int.from_bytes(item, "big") + 1) * power % PRIME
                total = (total + term) % PRIME
                power = power * BASE % PRIME
                sums.append(total.to_bytes(16, "big"))
                terms.append(term.to_bytes(16, "big"))
            arrays = [*batch.columns[:2], pa.array(sums, pa.binary()), pa.array(terms, pa.binary()), batch.column(3)]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "position", "sum", "term", "words"])

    sorted_items = items.select("conv_id", "position", "item", "words").repartitionByRange("conv_id", "position").sortWithinPartitions("conv_id", "position")
    local = sorted_items.mapInArrow(run, "conv_id long, position long, sum binary, term binary, words long")
    local = settle(local.select("*", F.spark_partition_id().alias("part")))
    # One row a range.
    edges = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "position", "sum")).alias("last")).orderBy("part").collect()
    brought, open_ends, conv, total, previous = {}, set(), None, 0, None
    for edge in edges:
        if edge.first == conv:
            brought[edge.part] = (conv, total)
            open_ends.add(previous)
        own = int.from_bytes(edge.last["sum"], "big")
        total = (own + (total if edge.first == conv and edge.last["conv_id"] == conv else 0)) % PRIME
        conv, previous = edge.last["conv_id"], edge.part
    return local, brought, open_ends


def _paths(items: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, words, ends): the node that each turn of each conversation leads to."""
    local, brought, open_ends = _summed(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        part = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            part = batch.column(5)[0].as_py()
            conv0, extra = brought.get(part, (None, 0))
            convs, sums, terms = (batch.column(i).to_pylist() for i in (0, 2, 3))
            nodes, parents = [], []
            for conv, own, term in zip(convs, sums, terms):
                node = (int.from_bytes(own, "big") + (extra if conv == conv0 else 0)) % PRIME
                nodes.append(node.to_bytes(16, "big"))
                parents.append(((node - int.from_bytes(term, "big")) % PRIME).to_bytes(16, "big"))
            depth = pa.array([p + 1 for p in batch.column(1).to_pylist()], pa.int64())
            new = [convs, depth, nodes, parents, batch.column(4)]
            if held is not None:
                yield _path_batch(held, convs[0])
            held = new
        if held is not None:
            yield _path_batch(held, held[0][-1] if part in open_ends else None)

    return local.mapInArrow(run, "conv_id long, depth long, node binary, parent binary, words long, ends boolean")


def _path_batch(held: list, following: int | None) -> pa.RecordBatch:
    """A batch, a turn being an end if another conversation follows it."""
    convs, depth, nodes, parents, words = held
    ends = [a != b for a, b in zip(convs, convs[1:] + [following])]
    arrays = [pa.array(convs, pa.int64()), depth, pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), words, pa.array(ends)]
    return pa.RecordBatch.from_arrays(arrays, ["conv_id", "depth", "node", "parent", "words", "ends"])


class MessageQueue:
    """Priority queue of (level, node, totals...) that writes sorted runs beyond ``limit`` messages."""

    def __init__(self, limit: int = HELD) -> None:
        self.limit = limit
        self.heap: list[tuple] = []
        self.runs: list[Iterator[tuple]] = []
        self.tops: list[tuple[tuple, int]] = []

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()  # noqa: SIM115  (the task's own scratch, gone when it is read or the task dies)
        self.heap.sort()
        for start in range(0, len(self.heap), 10_000):
            pickle.dump(self.heap[start : start + 10_000], file)
        self.heap = []
        file.seek(0)
        self.runs.append(_read(file))
        self._advance(len(self.runs) - 1)

    def _advance(self, run: int) -> None:
        message = next(self.runs[run], None)
        if message is not None:
            heapq.heappush(self.tops, (message, run))

    def pop_equal(self, level: int, node: bytes) -> Iterator[tuple]:
        """All messages for a node; none is left for a node before it."""
        while self.heap and self.heap[0][:2] == (level, node):
            yield heapq.heappop(self.heap)
        while self.tops and self.tops[0][0][:2] == (level, node):
            message, run = heapq.heappop(self.tops)
            yield message
            self._advance(run)


def _read(file) -> Iterator[tuple]:
    with file:
        while True:
            try:
                yield from pickle.load(file)
            except EOFError:
                return


def pass_totals(nodes: Iterator[tuple], limit: int = HELD) -> Iterator[tuple[int, int, int]]:
    """(children, leaves, saved) of nodes (depth, node, parent, saved, children, leaves, saved below, root) in reverse level order.

    The last four are what came from outside and whether the totals leave the shard here.
    """
    queue = MessageQueue(limit)
    for depth, node, parent, own, children, leaves, below, is_root in nodes:
        for _, _, more, more_below in queue.pop_equal(-depth, node):
            children += 1
            leaves += more
            below += more_below
        leaves = leaves if children else 1
        saved = own + below
        if not is_root:
            queue.push((1 - depth, parent, leaves, saved))
        yield children, leaves, saved


NODE = "depth long, node binary, parent binary, conv_id long, n_convs long, is_root boolean, n_children long, n_leaves long, saved_tokens long"


def _pass(nodes: DataFrame, limit: int) -> DataFrame:
    """Totals of sorted partitions (depth, node, parent, own, n_children, n_leaves, below, is_root, conv_id, n_convs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[pa.RecordBatch] = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                if batch.num_rows:
                    seen.append(batch)
                    yield from zip(*(batch.column(i).to_pylist() for i in range(8)))

        found: list[tuple] = []
        for totals in pass_totals(rows(), limit):
            found.append(totals)
            if len(found) == seen[0].num_rows:
                yield _totals_batch(seen.pop(0), found)
                found = []

    return nodes.mapInArrow(run, NODE)


def _totals_batch(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
    totals = [pa.array(c, pa.int64()) for c in zip(*found)]
    arrays = [batch.column(c) for c in ("depth", "node", "parent", "conv_id", "n_convs", "is_root")] + totals
    return pa.RecordBatch.from_arrays(arrays, ["depth", "node", "parent", "conv_id", "n_convs", "is_root", *TOTALS])


def _hashed_ends(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of rows (depth, node, conv_id): one hash of the ids in order, joined by commas."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []
        for batch in batches:
            rows = []
            for depth, node, conv in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if ids and ((depth, node) != now or len(ids) == PACKED_IDS):
                    rows.append((*now, ids[0], ",".join(map(str, ids))))
                    ids = []
                now = depth, node
                ids.append(conv)
            yield _table(rows, (pa.int64(), pa.binary(), pa.int64(), pa.string()), ["depth", "node", "first", "ids"])
        if ids:
            yield _table([(*now, ids[0], ",".join(map(str, ids)))], (pa.int64(), pa.binary(), pa.int64(), pa.string()), ["depth", "node", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            rows = []
            for depth, node, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if (depth, node) == now:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    rows.append((*now, state.hexdigest()))
                now, state = (depth, node), hashlib.sha256(ids.encode())
            yield _table(rows, (pa.int64(), pa.binary(), pa.string()), ["depth", "node", "ends_sha256"])
        if state is not None:
            yield _table([(*now, state.hexdigest())], (pa.int64(), pa.binary(), pa.string()), ["depth", "node", "ends_sha256"])

    order = ["depth", "node", "conv_id"]
    packed = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, "depth long, node binary, first long, ids string")
    by_node = packed.repartition("depth", "node").sortWithinPartitions("depth", "node", "first")
    return by_node.mapInArrow(digest, "depth long, node binary, ends_sha256 string")


def _table(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def build(items: DataFrame, conversations: DataFrame, share: int | None = None, limit: int = HELD) -> DataFrame:
    """Every node of the trie with its totals.

    ``items`` has (conv_id, position, item, words) with dense positions from 0, ``conversations`` the ids of all
    conversations, those without turns included. ``share`` is the number of conversations above which a node is of the
    crown (a quarter of an even share of a partition by default), ``limit`` the messages held in memory.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node, parent); ``conv_id``
    is the smallest member, ``saved_tokens`` what sharing the nodes of the subtree saves in words of their last turns.
    """
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    convs = conversations.select(conversations.columns[0]).toDF("conv_id").where("conv_id IS NOT NULL").distinct()
    paths = settle(_paths(items))
    turnless = convs.join(paths.where("depth = 1").select("conv_id"), "conv_id", "left_anti")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    named = paths.groupBy("depth", "node").agg(
        F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words")
    )
    top = root.select(F.lit(0).cast("long").alias("depth"), F.lit(bytearray(ROOT)).alias("node"), F.lit(bytearray(ROOT)).alias("parent"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))
    nodes = settle(named.unionByName(top))
    if share is None:
        share = (nodes.where("depth = 0").agg(F.max("n_convs")).first()[0] or 0) // (4 * parts)
    nodes = nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("words"))
    in_crown = (F.col("n_convs") > share) | (F.col("depth") == 0)
    crown, below = nodes.where(in_crown), nodes.where(~in_crown)

    shards = paths.join(crown.select("depth", "node"), ["depth", "node"], "left_anti").groupBy("conv_id").agg(F.min(F.struct("depth", "node")).alias("shard"))
    none = F.lit(0).cast("long")
    columns = ["depth", "node", "parent", "own", "n_children", "n_leaves", "below", "is_root", "conv_id", "n_convs"]
    hung = below.join(shards, "conv_id").withColumns(
        {"n_children": none, "n_leaves": none, "below": none, "is_root": F.struct("depth", "node") == F.col("shard")}
    )
    level = [F.desc("depth"), F.asc("node")]
    spread = hung.repartition("shard").sortWithinPartitions(*level).select(*columns)
    low = settle(_pass(spread, limit))

    sent = low.where("is_root").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node"))
    sent = sent.agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
    fed = crown.join(sent, ["depth", "node"], "left").fillna(0, ["n_children", "n_leaves", "below"]).withColumn("is_root", F.col("depth") == 0)
    high = _pass(fed.select(*columns).repartition(1).sortWithinPartitions(*level), limit)

    ends = paths.where("ends").select("depth", "node", "conv_id").unionByName(
        turnless.select(none.alias("depth"), F.lit(bytearray(ROOT)).alias("node"), "conv_id")
    )
    whole = low.unionByName(high)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    joined = whole.join(parents, ["depth", "parent"], "left").join(_hashed_ends(ends), ["depth", "node"], "left")
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", *TOTALS, F.coalesce("ends_sha256", empty).alias("ends_sha256"), "node", F.when(F.col("depth") > 0, F.col("parent")).alias("parent")
    )
