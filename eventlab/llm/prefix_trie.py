"""Prefix trie of conversations by time-forward processing.

A node of depth d is a distinct sequence of first d turns. Subtree totals (leaves
and the tokens that sharing saves) flow from the leaves to the root:

1. Turns are numbered inside their conversation, conversations are rebuilt, and a
   running exclusive-or of hashes of (place, turn) names every prefix with 128
   bits. A prefix less its last turn is its parent, so no row looks at another.
2. Nodes are counted by a partial aggregate of these names.
3. The trie is cut into fragments: a node begins one at every ``DEEP``-th depth and
   below every node of more than ``HEAVY`` conversations. So a fragment holds at
   most ``HEAVY * DEEP`` nodes, whatever prefix is shared by how many.
4. Fragments are dealt to shards (Spark partitions) and externally sorted there by
   reverse level order. A node takes the messages of its children from a priority
   queue that spills sorted runs, and sends its totals to its parent.
5. What a fragment's first node has gathered goes across shards to its parent in a
   shallower fragment: fragments are processed by their level, deepest first, and
   messages to one parent are summed in a partial aggregate on the way.

Windows hold at most ``CHUNK`` turns of a conversation (more only if as many turn
numbers are equal or null); longer ones carry sums from chunk to chunk.

Defined cases: rows without a conv_id take no part; null roles and texts are
empty; a null turn comes first, rows of one turn number are ordered by role and
text (repeated rows are turns of their own); a table without conversations has no
node, one whose conversations are all rebuilt without turns has the root alone.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlab.llm.common import small_side
from eventlab.sources.files import stage

#: Depth of a fragment, and conversations of a node below which fragments begin.
DEEP, HEAVY = 256, 4096
#: Turns of one conversation that a window holds (a multiple of DEEP).
CHUNK = 4096
#: Messages in memory before a queue spills.
QUEUE = 1 << 18
#: Conversation ids joined to one piece of a digest.
PIECE = 4096


def _first_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its five."""
    return (F.crc32(conv_id.cast("string")) % 9).cast("int")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, t1, t2, bytes): turns by their place from 1, texts as hashes."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    rows = rows.withColumn("chunk", F.coalesce(F.floor(F.col("turn") / CHUNK).cast("long"), F.lit(-2**62)))
    order = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    per = rows.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("k"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = stage(per.withColumn("before", F.sum("k").over(earlier)).where("before > 0").drop("k"), "turn-offsets")
    placed = rows.withColumn("_rn", F.row_number().over(order)).select(
        "conv_id", "chunk", "_rn", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit("t2"), "text", "role").alias("t2"),
        F.octet_length("text").cast("long").alias("bytes"))
    placed = placed.join(small_side(before), ["conv_id", "chunk"], "left")
    return placed.select("conv_id", (F.col("_rn") + F.coalesce("before", F.lit(0))).cast("long").alias("at"), "t1", "t2", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, size) of every rebuilt conversation, its turns (conv_id, size, at,
    t1, t2, bytes)): the first h turns of the first conversation of its five, then
    its own after as many."""
    own = stage(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")), "conversation-sizes")
    c = own.withColumn("h", _first_turns(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
    base = own.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    c = c.join(base, "base", "left").withColumn("taken", F.least(F.col("h"), F.coalesce("base_own", F.lit(0))).cast("long"))
    size = F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    c = stage(c.select("conv_id", "base", "h", "taken", size.cast("long").alias("size")), "conversations")
    lent = turns.where(F.col("at") <= 8).withColumnRenamed("conv_id", "base").join(c, "base").where("at <= taken")
    kept = turns.join(small_side(c), "conv_id").where("at > h").withColumn("at", F.col("at") - F.col("h") + F.col("taken"))
    cols = ["conv_id", "size", "at", "t1", "t2", "bytes"]
    return c.select("conv_id", "size"), lent.select(*cols).unionByName(kept.select(*cols))


def _carried(rows: DataFrame, chunks: DataFrame, sums: dict[str, Callable]) -> DataFrame:
    """Running values of ``sums`` (column to its aggregate) along each conversation.
    ``chunks`` holds the turns of conversations of several chunks."""
    inside = (Window.partitionBy("conv_id", "chunk").orderBy("at")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per = chunks.groupBy("conv_id", "chunk").agg(*[agg(c).alias(c) for c, agg in sums.items()])
    before = per.select("conv_id", "chunk", *[agg(c).over(earlier).alias(f"before_{c}") for c, agg in sums.items()])
    before = stage(before.where(" and ".join(f"before_{c} is not null" for c in sums)), "turn-carries")
    run = rows.withColumns({f"run_{c}": agg(c).over(inside) for c, agg in sums.items()})
    run = run.join(small_side(before), ["conv_id", "chunk"], "left")
    both = {c: ((lambda a, b: a.bitwiseXOR(b)) if agg is F.bit_xor else (lambda a, b: a + b)) for c, agg in sums.items()}
    return run.withColumns({f"run_{c}": both[c](F.col(f"run_{c}"), F.coalesce(f"before_{c}", F.lit(0))) for c in sums}
                           ).drop(*[f"before_{c}" for c in sums])


def named_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, size, at, bytes, chunk, k1, k2, p1, p2): the name of the prefix that
    ends at each turn and its parent's (0, 0 is the root)."""
    rows = turns.withColumn("chunk", F.floor((F.col("at") - 1) / CHUNK))
    rows = rows.withColumns({"e1": F.xxhash64("at", "t1", "t2"), "e2": F.xxhash64("t2", "at", "t1")})
    run = _carried(rows, rows.where(F.col("size") > CHUNK), {"e1": F.bit_xor, "e2": F.bit_xor})
    return run.select("conv_id", "size", "at", "bytes", "chunk", F.col("run_e1").alias("k1"), F.col("run_e2").alias("k2"),
                      F.col("run_e1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("run_e2").bitwiseXOR(F.col("e2")).alias("p2"))


def trie_nodes(rows: DataFrame, deep: int = DEEP, heavy: int = HEAVY) -> DataFrame:
    """(depth, k1, k2, p1, p2, n_convs, conv_id, own, f1, f2, level): the nodes below
    the root with their fragment (the name of its first node) and its level."""
    often = (rows.groupBy("at", "k1", "k2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy)
             .select((F.col("at") + 1).alias("at"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.lit(1).alias("below")))
    often = stage(often, "trie-heavy")
    cut = (F.col("below").isNotNull() | (F.col("at") % deep == 1 % deep)).cast("long")
    rows = rows.join(small_side(often), ["at", "p1", "p2"], "left").withColumn("cut", cut).drop("below")
    if not often.isEmpty():
        rows = stage(rows, "trie-cuts")
    run = _carried(rows, rows.where(F.col("size") > CHUNK), {"cut": F.sum})
    inside = (Window.partitionBy("conv_id", "chunk").orderBy("at")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # every chunk begins with a cut, so the last cut is in the chunk
    first = F.last(F.when(F.col("cut") == 1, F.struct("k1", "k2")), ignorenulls=True).over(inside)
    run = run.withColumn("f", first)
    return (run.groupBy(F.col("at").alias("depth"), "k1", "k2")
            .agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.count(F.lit(1)).alias("n_convs"),
                 F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"), F.first("f").alias("f"),
                 F.first("run_cut").cast("int").alias("level"))
            .select("depth", "k1", "k2", "p1", "p2", "n_convs", "conv_id",
                    ((F.col("n_convs") - 1) * F.col("bytes")).alias("own"), "f.k1", "f.k2", "level")
            .toDF("depth", "k1", "k2", "p1", "p2", "n_convs", "conv_id", "own", "f1", "f2", "level"))


class SpillingQueue:
    """Messages in order of their key. Beyond ``most`` in memory a sorted run goes to
    an anonymous file of the task, which ends with it."""

    def __init__(self, most: int = QUEUE):
        self.most, self.heap, self.runs = most, [], []

    def push(self, key: tuple, *values: int) -> None:
        heapq.heappush(self.heap, (key, *values))
        if len(self.heap) >= self.most:
            run = tempfile.TemporaryFile()
            for message in sorted(self.heap):
                pickle.dump(message, run, pickle.HIGHEST_PROTOCOL)
            run.seek(0)
            self.heap = []
            self._next(run)

    def _next(self, run) -> None:
        try:
            heapq.heappush(self.runs, (pickle.load(run), id(run), run))
        except EOFError:
            run.close()

    def take(self, key: tuple) -> Iterator[tuple]:
        """The values of all messages to ``key``."""
        while self.heap and self.heap[0][0] == key:
            yield heapq.heappop(self.heap)[1:]
        while self.runs and self.runs[0][0][0] == key:
            message, _, run = heapq.heappop(self.runs)
            self._next(run)
            yield message[1:]

    def __len__(self) -> int:
        return len(self.heap) + len(self.runs)


def time_forward(nodes: DataFrame, most: int = QUEUE) -> DataFrame:
    """Totals of the nodes of one level of fragments: (depth, k1, k2, p1, p2,
    n_children, n_leaves, saved_tokens, top). ``nodes`` also holds what came from
    deeper fragments (children, leaves, saved); ``top`` marks fragments' first nodes."""
    cols = ["f1", "f2", "depth", "k1", "k2", "p1", "p2", "own", "children", "leaves", "saved"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, fragment = SpillingQueue(most), None
        for b in batches:
            out = []
            for f1, f2, depth, k1, k2, p1, p2, own, children, leaves, saved in zip(*(c.to_pylist() for c in b.columns)):
                if (f1, f2) != fragment:
                    assert not len(queue), "a message has found no node"
                    fragment = (f1, f2)
                saved += own
                for more_leaves, more_saved in queue.take((-depth, k1, k2)):
                    children, leaves, saved = children + 1, leaves + more_leaves, saved + more_saved
                leaves = leaves if children else 1
                top = fragment == (k1, k2)
                if not top:
                    queue.push((1 - depth, p1, p2), leaves, saved)
                out.append((depth, k1, k2, p1, p2, children, leaves, saved, top))
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out)], names=names)

    names = ["depth", "k1", "k2", "p1", "p2", "n_children", "n_leaves", "saved_tokens", "top"]
    shards = nodes.select(*cols).repartition("f1", "f2").sortWithinPartitions("f1", "f2", F.col("depth").desc(), "k1", "k2")
    return shards.mapInArrow(run, ", ".join(f"{c} long" for c in names[:-1]) + ", top boolean")


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of every node where conversations end. ``rows`` is
    (depth, k1, k2, conv_id). Ids are joined to pieces in parallel; the pieces of a
    node are digested in order, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for b in batches:
            done = []
            for depth, k1, k2, piece in zip(*(c.to_pylist() for c in b.columns)):
                if (depth, k1, k2) != node:
                    done += [(*node, digest.hexdigest())] if node else []
                    node, digest = (depth, k1, k2), hashlib.sha256(piece.encode())
                else:
                    digest.update(b"," + piece.encode())
            if done:
                yield pa.record_batch([pa.array(c) for c in zip(*done)], names=names)
        if node:
            yield pa.record_batch([pa.array([c]) for c in (*node, digest.hexdigest())], names=names)

    names = ["depth", "k1", "k2", "ends_sha256"]
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = rows.groupBy("depth", "k1", "k2", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(F.array_join(ids, ",").alias("ids"))
    ordered = pieces.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "piece")
    return ordered.select("depth", "k1", "k2", "ids").mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def _messages(done: DataFrame) -> DataFrame:
    """What the parents of fragments' first nodes get, summed."""
    return done.where("top").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))


def prefix_trie(conversations: DataFrame, deep: int = DEEP, heavy: int = HEAVY, queue: int = QUEUE) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256 of every node of the rebuilt conversations' trie."""
    sizes, turns = rebuilt(stage(numbered_turns(conversations), "turns"))
    sizes = stage(sizes, "rebuilt-sizes")
    rows = stage(named_prefixes(turns), "prefixes")
    nodes = stage(trie_nodes(rows, deep, heavy), "trie-nodes", ["level"])
    top = sizes.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first")).first()
    levels = nodes.agg(F.max("level").alias("m")).first()["m"] or 0

    key, totals, sent = ["depth", "k1", "k2"], None, None
    for level in range(levels, 0, -1):
        mine = nodes.where(F.col("level") == level)
        mine = mine.join(sent, key, "left").fillna(0, ["children", "leaves", "saved"]) if sent is not None else (
            mine.withColumns({c: F.lit(0).cast("long") for c in ("children", "leaves", "saved")}))
        done = stage(time_forward(mine, queue), "trie-totals")
        sent = stage(_messages(done), "trie-messages")
        totals = done if totals is None else totals.unionByName(done)

    ends = rows.where("at = size").select(F.col("at").alias("depth"), "k1", "k2", "conv_id")
    none = sizes.where("size = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"),
                                          F.lit(0).cast("long").alias("k2"), "conv_id")
    digests = stage(_ends(ends.unionByName(none)), "trie-ends")
    root = sizes.sparkSession.createDataFrame(
        [(0, 0, 0, None, top["n"], top["first"])] if top["n"] else [],
        "depth long, k1 long, k2 long, parent_conv_id long, n_convs long, conv_id long")
    below = F.struct(F.lit(0).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    if sent is not None:
        root = root.join(sent, key, "left")
        root = root.withColumns({c: F.coalesce(F.col(c), below[c]) for c in ("children", "leaves", "saved")})
    else:
        root = root.withColumns({c: below[c] for c in ("children", "leaves", "saved")})
    root = root.withColumnsRenamed({"children": "n_children", "leaves": "n_leaves", "saved": "saved_tokens"})
    every = root
    if totals is not None:
        slim = nodes.select(*key, "p1", "p2", "n_convs", "conv_id")
        parents = slim.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                              F.col("conv_id").alias("parent_conv_id"))
        first = slim.where("depth = 1").withColumn("parent_conv_id", F.lit(top["first"]).cast("long"))
        named = first.unionByName(slim.where("depth > 1").join(parents, ["depth", "p1", "p2"]).select(*first.columns))
        every = root.unionByName(named.drop("p1", "p2").join(totals.drop("p1", "p2", "top"), key).select(*root.columns))
    full = every.join(digests, key, "left")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                       F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op12_prefix_trie(conversations: DataFrame) -> DataFrame:
    """Contract columns are those of ``prefix_trie``."""
    return prefix_trie(conversations)


OP12_SQL = """
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list({'role': role, 'text': text} ORDER BY place) AS l FROM t GROUP BY c
), h AS (
  SELECT c, l, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(CAST(c AS VARCHAR)) + 1),
                                 lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT))),
                               lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                                        lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 9 AS h
  FROM own
), r AS (
  SELECT h.c, list_concat(coalesce(b.l[1:h.h], []), h.l[h.h + 1:]) AS path FROM h LEFT JOIN own b ON b.c = h.c - h.c % 5
), p AS (
  SELECT c, path[1:d] AS path, d, len(path) = d AS ends FROM r, unnest(range(0, len(path) + 1)) AS u(d)
), n AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * octet_length(encode(path[d].text)) END AS own
  FROM p GROUP BY path, d
), k AS (
  SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL
), f AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path, d)
), s AS (
  SELECT path[1:a] AS path, a AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens
  FROM f, unnest(range(0, d + 1)) AS u(a) GROUP BY ALL
)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM f JOIN s USING (path, d) LEFT JOIN n q ON q.d = f.d - 1 AND q.path = f.path[1:f.d - 1]
"""
