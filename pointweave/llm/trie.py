"""Prefix trie of conversations, with subtree totals by time-forward processing.

Turns are dealt to slices by ranges of (conversation, turn), so that one long conversation is many slices, and numbered
within them; the few conversations over a slice border get the counts of the slices before. A prefix is known by its length
and two 64-bit digests: the exclusive or of the digests of (position, turn) over its turns, which running windows give and
which slices can carry on. So no task holds a whole conversation, and texts never travel, only their digests and lengths.

Totals go from the leaves to the root. Nodes of more than ``least`` members are heavy; the bar rises with the input so that
there are at most ``MOST_HEAVY`` of them, which bounds every broadcast. The trie falls into the subtrees below heavy nodes,
which are dealt to shards by the digest of their top. In a shard the nodes are sorted externally in reverse level order, by
Spark, and pass their totals forward in time to their parents through a priority queue that spills sorted runs to disk. What
leaves the shards is added up per heavy parent before it travels, and the heavy nodes, the tops of the shards, are processed
the same way at the end.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import discard, stored

#: At most so many nodes are heavy, whatever the input.
MOST_HEAVY = 65_536
LEAST = 1024
#: Messages that a priority queue holds in memory.
IN_MEMORY = 500_000
SLICE_ROWS = 250_000
SHARD_NODES = 250_000
LONGEST_HEAD = 5
NO_ENDS = hashlib.sha256(b"").hexdigest()

_RECORD = struct.Struct("<qqqqqq")


class SpillingQueue:
    """Messages to nodes (three numbers each), smallest key first. Beyond ``limit``, sorted runs go to unlinked files."""

    def __init__(self, limit: int = IN_MEMORY):
        self.limit = limit
        self.young: list[tuple[int, ...]] = []
        #: Runs on disk, each by its next message.
        self.runs: list[tuple[tuple[int, ...], int, Iterator[tuple[int, ...]]]] = []
        self.made = 0

    def push(self, message: tuple[int, ...]) -> None:
        if len(self.young) >= self.limit:
            self._spill()
        heapq.heappush(self.young, message)

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        for message in sorted(self.young):
            file.write(_RECORD.pack(*message))
        file.seek(0)
        self.young.clear()
        self._next(iter(lambda: file.read(_RECORD.size), b""))

    def _next(self, raw: Iterator[bytes]) -> None:
        record = next(raw, None)
        if record is not None:
            self.made += 1
            heapq.heappush(self.runs, (_RECORD.unpack(record), self.made, raw))

    def take(self, key: tuple[int, int, int]) -> Iterator[tuple[int, ...]]:
        """All messages to ``key``. Keys are asked for in ascending order; those left out are nodes of other shards."""
        while self.young and self.young[0][:3] <= key:
            message = heapq.heappop(self.young)
            if message[:3] == key:
                yield message
        while self.runs and self.runs[0][0][:3] <= key:
            message, _, raw = heapq.heappop(self.runs)
            if message[:3] == key:
                yield message
            self._next(raw)


NODE = ["depth", "x", "y", "up_x", "up_y", "conv_id", "n_convs", "chars"]
TOTALS = ["n_children", "n_leaves", "saved_tokens"]


def _forward(limit: int):
    """Totals of nodes that come sorted by depth, deepest first, then digests.

    Rows with ``n_convs`` null are messages from other shards to the node of the same key; they come before it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(limit)
        from_outside: list[tuple[int, ...]] = []
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in (*NODE, *TOTALS)}
            keep, totals = [], []
            for i, (depth, x, y, up_x, up_y, _, members, chars) in enumerate(zip(*(columns[n] for n in NODE))):
                if members is None:
                    from_outside.append((-depth, x, y, *(columns[n][i] for n in TOTALS)))
                    continue
                children, leaves, saved = 0, 0, (members - 1) * chars
                for message in (*from_outside, *queue.take((-depth, x, y))):
                    children += message[3]
                    leaves += message[4]
                    saved += message[5]
                from_outside.clear()
                keep.append(i)
                totals.append((children, leaves or 1, saved))
                queue.push((1 - depth, up_x, up_y, 1, leaves or 1, saved))
            found = batch.select(NODE).take(pa.array(keep, pa.int64()))
            out = np.array(totals, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*found.columns, *(pa.array(out[:, c]) for c in range(3))], [*NODE, *TOTALS])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's number among the rows of its conversation, which come one after the other."""
    last, count = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_numpy()
        new = np.concatenate([[ids[0] != last], ids[1:] != ids[:-1]])
        start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
        number = np.where(start < 0, count + 1 + np.arange(len(ids)), np.arange(len(ids)) - start + 1)
        last, count = ids[-1], int(number[-1])
        yield batch.append_column("number", pa.array(number.astype(np.int64)))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the lists of a node, which come one after the other in order, joined by commas."""
    key, digest = None, None
    for batch in batches:
        out: list[tuple] = []
        for depth, x, y, ids in zip(*(batch.column(n).to_pylist() for n in ("depth", "x", "y", "ids"))):
            if (depth, x, y) == key:
                digest.update(b",")
            else:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (depth, x, y), hashlib.sha256()
            digest.update(ids.encode())
        yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in out], pa.int64()) for c in range(3)),
                                          pa.array([r[3] for r in out], pa.string())], ["depth", "x", "y", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([digest.hexdigest()])],
                                         ["depth", "x", "y", "ends_sha256"])


def _long(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def _placed(depth: Column, digest: Column, salt: int) -> Column:
    return F.xxhash64(depth.cast("bigint"), digest, F.lit(salt))


def head_length(conv_id: Column) -> Column:
    """How many turns a conversation takes over."""
    return F.crc32(conv_id.cast("string").cast("binary")) % (LONGEST_HEAD + 1)


def sliced_turns(turns: DataFrame, slice_rows: int) -> DataFrame:
    """``slice, conv_id, number, a, b, chars``: digests and length of every turn, numbered within slice and conversation.

    Turns of a conversation are ordered by ``turn`` (null first), equal ones by role, then by digest.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"),
        F.xxhash64(role, text, F.lit(1)).alias("a"), F.xxhash64(text, role, F.lit(2)).alias("b"),
        F.length(text).cast("bigint").alias("chars"))
    n = max(turns.sparkSession.sparkContext.defaultParallelism, -(-turns.count() // slice_rows))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("a")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = T.StructType([*dealt.schema.fields, T.StructField("number", T.LongType())])
    return dealt.mapInArrow(_numbered, schema).select(
        F.spark_partition_id().cast("bigint").alias("slice"), "conv_id", "number", "a", "b", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations with the prefixes that end with them; and the conversations themselves.

    ``turns`` is the result of ``sliced_turns``. The first table has ``slice, conv_id, depth, x, y, up_x, up_y, chars,
    is_end``, without the root; the second ``slice, conv_id, turns`` with the slice that a conversation ends in.
    """
    by_conv = Window.partitionBy("conv_id").orderBy("slice")
    counts = turns.groupBy("slice", "conv_id").agg(F.count("*").alias("n"))
    # A conversation has one row here for each slice that it is in.
    parts = counts.select(
        "slice", "conv_id", "n", (F.sum("n").over(by_conv) - F.col("n")).alias("before"),
        F.lead("slice").over(by_conv).isNull().alias("last"), (F.sum("n").over(Window.partitionBy("conv_id"))).alias("own"))
    step = lambda r, side: _placed(r["pos"], r[side], 3 if side == "a" else 4)
    heads = turns.filter(F.col("conv_id") % 100 == 0).filter(F.col("number") <= LONGEST_HEAD).join(
        parts.filter(F.col("before") < LONGEST_HEAD).select("slice", "conv_id", "before"), ["slice", "conv_id"]).select(
        F.col("conv_id").alias("base"), (F.col("before") + F.col("number")).alias("pos"), "a", "b", "chars").filter(
        F.col("pos") <= LONGEST_HEAD).groupBy("base").agg(F.sort_array(F.collect_list(F.struct("pos", "a", "b", "chars"))).alias("given"))
    xor = lambda side: F.aggregate("head", F.lit(0).cast("bigint"), lambda s, r: s.bitwiseXOR(step(r, side)))
    given = F.coalesce("given", F.array().cast("array<struct<pos:bigint,a:bigint,b:bigint,chars:bigint>>"))
    known = parts.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", head_length(F.col("conv_id"))).join(
        heads, "base", "left").withColumn("head", F.slice(given, 1, F.col("h").cast("int"))).select(
        "slice", "conv_id", "before", "last", "own", "h", "head", F.size("head").cast("bigint").alias("taken"),
        xor("a").alias("head_x"), xor("b").alias("head_y")).withColumn(
        "turns", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    # The head's turns, with running digests.
    upto = lambda side: F.transform("head", lambda r, i: F.aggregate(
        F.slice("head", F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda s, e: s.bitwiseXOR(step(e, side))))
    of_head = known.filter("last").select("slice", "conv_id", "turns", F.explode(F.arrays_zip(
        "head", upto("a").alias("px"), upto("b").alias("py"))).alias("e")).select(
        "slice", "conv_id", F.col("e.head.pos").alias("depth"), F.col("e.px").alias("x"), F.col("e.py").alias("y"),
        F.col("e.px").bitwiseXOR(step(F.col("e.head"), "a")).alias("up_x"),
        F.col("e.py").bitwiseXOR(step(F.col("e.head"), "b")).alias("up_y"), F.col("e.head.chars").alias("chars"),
        (F.col("e.head.pos") == F.col("turns")).alias("is_end"))
    # The own turns after it. Slices go on from what the slices before them add up to.
    depth = F.col("before") + F.col("number") - F.col("h") + F.col("taken")
    own = turns.join(known.drop("head", "own"), ["slice", "conv_id"]).filter(
        F.col("before") + F.col("number") > F.col("h")).withColumn("depth", depth).withColumn(
        "dx", _placed(F.col("depth"), F.col("a"), 3)).withColumn("dy", _placed(F.col("depth"), F.col("b"), 4))
    running = Window.partitionBy("slice", "conv_id").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    summed = own.select("slice", "conv_id", "last", "head_x", "head_y", "depth", "turns", "dx", "dy", "chars",
                        F.expr("bit_xor(dx)").over(running).alias("rx"), F.expr("bit_xor(dy)").over(running).alias("ry"))
    # Only conversations over a slice border have more than one part: at most one for each border.
    spanning = own.filter(~F.col("last") | (F.col("before") > 0)).groupBy("slice", "conv_id").agg(
        F.expr("bit_xor(dx)").alias("sx"), F.expr("bit_xor(dy)").alias("sy"))
    earlier = by_conv.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    carried = spanning.select("slice", "conv_id", F.coalesce(F.expr("bit_xor(sx)").over(earlier), none).alias("cx"),
                              F.coalesce(F.expr("bit_xor(sy)").over(earlier), none).alias("cy"))
    x, y = (F.col(f"r{s}").bitwiseXOR(F.coalesce(f"c{s}", none)).bitwiseXOR(F.col(f"head_{s}")) for s in "xy")
    of_own = summed.join(F.broadcast(carried), ["slice", "conv_id"], "left").select(
        "slice", "conv_id", "depth", x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("dx")).alias("up_x"),
        y.bitwiseXOR(F.col("dy")).alias("up_y"), "chars", (F.col("depth") == F.col("turns")).alias("is_end"))
    return of_head.unionByName(of_own), known.filter("last").select("slice", "conv_id", "turns")


def trie(conversations: DataFrame, least: int = LEAST, slice_rows: int = SLICE_ROWS, shard_nodes: int = SHARD_NODES,
         in_memory: int = IN_MEMORY) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``conversations`` has ``conv_id, turn, role, text``. Conversation c starts with the first h turns of conversation
    c - c % 100 (all if it has fewer, none if there is no such), h = ``head_length``, and goes on with its own turns after
    its first h. Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    Null roles and texts are empty ones, null turns come first, turns of equal number are ordered by role and digest and
    all count, also equal rows. Rows without a ``conv_id`` belong to no conversation. An empty table has no nodes. Other
    columns are ignored. Two different prefixes of one length are one node only if both 64-bit digests agree. The list
    that SHA-256 reads is a sequence by definition: a node's ids come in lists per slice, and are streamed.
    """
    spark = conversations.sparkSession
    turns = stored(sliced_turns(conversations, slice_rows))
    rows, convs = (stored(t) for t in rebuilt(turns))
    key = ["depth", "x", "y"]
    nodes = stored(rows.groupBy(*key).agg(
        F.min("up_x").alias("up_x"), F.min("up_y").alias("up_y"), F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"), F.max("chars").alias("chars")).select(*NODE))
    n_convs, first = convs.agg(F.count("*"), F.min("conv_id")).first()
    n_rows, n_nodes = (t.count() for t in (rows, nodes))
    schema = T.StructType([*_long(*NODE, *TOTALS)])
    none = [F.lit(None).cast("bigint").alias(n) for n in TOTALS]
    root = spark.createDataFrame([(0, 0, 0, 0, 0, first, n_convs, 0)] if n_convs else [], _long(*NODE))
    # Every row or conversation is in one node of each depth, so nodes above the bar are fewer than rows / bar.
    bar = max(least, -(-(n_rows + n_convs) // MOST_HEAVY))
    heavy = stored(nodes.filter(F.col("n_convs") > bar).unionByName(root))
    light = nodes.filter(F.col("n_convs") <= bar)
    tops = F.broadcast(heavy.select(F.col("depth").alias("up_depth"), F.col("x").alias("up_x"), F.col("y").alias("up_y"),
                                    F.col("conv_id").alias("heavy_conv")))
    above = lambda t: t.withColumn("up_depth", F.col("depth") - 1).join(tops, ["up_depth", "up_x", "up_y"], "left")
    # The subtree that a node is in is the one that its smallest member goes through.
    cuts = above(light).filter("heavy_conv is not null").select(*key)
    of_conv = rows.join(cuts, key, "left_semi").select("conv_id", F.col("x").alias("top"))
    shards = max(1, -(-n_nodes // shard_nodes))
    order = [F.desc("depth"), F.col("x"), F.col("y")]
    shard = F.pmod(F.xxhash64("top"), F.lit(shards))
    below = stored(light.join(of_conv, "conv_id").repartition(shards, shard).sortWithinPartitions(*order).select(
        *NODE, *none).mapInArrow(_forward(in_memory), schema))
    arrived = above(below).filter("heavy_conv is not null").groupBy("up_depth", "up_x", "up_y").agg(
        F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    messages = arrived.select(F.col("up_depth").alias("depth"), F.col("up_x").alias("x"), F.col("up_y").alias("y"),
                              *[F.lit(None).cast("bigint").alias(n) for n in NODE[3:]], *TOTALS)
    # At most MOST_HEAVY nodes and as many messages, which come before their node.
    upper = heavy.select(*NODE, *none).unionByName(messages).repartition(1).sortWithinPartitions(
        *order, F.col("n_convs").asc_nulls_first()).mapInArrow(_forward(in_memory), schema)
    whole = below.unionByName(upper)
    parents = light.select(
        F.col("depth").alias("up_depth"), F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("conv_id").alias("light_conv"))
    lists = rows.filter("is_end").select("slice", "conv_id", *key).unionByName(
        convs.filter("turns = 0").select("slice", "conv_id", *[F.lit(0).cast("bigint").alias(k) for k in key])).groupBy(
        "slice", *key).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ends = lists.repartition(*key).sortWithinPartitions(*key, "slice").mapInArrow(
        _digests, T.StructType([*_long(*key), T.StructField("ends_sha256", T.StringType())]))
    result = above(whole).join(parents, ["up_depth", "up_x", "up_y"], "left").join(ends, key, "left")
    out = result.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("heavy_conv", "light_conv")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    discard(turns)
    return out
