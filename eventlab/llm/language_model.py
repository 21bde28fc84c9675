"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax.

Every word has a path through a tree of classes: at each class a softmax over its
(at most) 16 members says which comes next, given the history:

    P(w | h) = product over the path of softmax(bias(class) + weights of features(h, class))[member]

The tree is the 16-ary Huffman tree of the training counts, so frequent words take
one or two choices. Its leaves are the ``OWN_LEAVES`` most frequent words, and
``SHARED_LEAVES`` leaves that the other words fall into by their hash. A word of a shared
leaf has the smoothed share (c + 0.1) / (N + 0.1 * (V + 1)) of it, N and V being the
count and the number of training words there; the 0.1 left is that of unseen words.

Features of a history, each joined with the class where the choice is made, are the
word before (n-gram) and the word two back (skip): whole words, hashed into a table of
16 weights a row. The table has one row for about ``TOKENS_A_ROW`` training tokens, up to
2**``MAX_BITS`` rows (32 MB), the documented bound of what is broadcast. The bias
of a class is the logarithm of its members' training counts and stays as it is.

Training reads every training text once, in ``ROUNDS`` rounds of texts dealt by their
hash. In a round each task goes on from the shared weights with AdaGrad steps over its
texts; its changes, in blocks of rows, are shuffled by block and averaged by the
squared gradients behind them. Scores are sums over numpy batches of words.

Word counts are exact at every size: those of the most used words (``KNOWN_WORDS`` at
most) are broadcast, the others of a text are joined by a shuffle and summed per text.
Words are byte strings outside white space with A-Z in lower case, and every text ends
with one end token.

Defined cases: null and empty texts consist of the end token. Equal rows (id
and text) get equal scores, one row each. With nothing to learn from, counts are zero
and the members of a class are equally likely.
"""

from __future__ import annotations

import heapq
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlab.llm.common import fold_remainder, mix64, span_hashes, text_key, text_slices, word_spans
from eventlab.sources.files import stage

SMOOTH = 0.1
#: Members of a class; leaves of single words; leaves that the other words share.
WAYS = 16
OWN_LEAVES, SHARED_BITS = 32_768, 8
SHARED_LEAVES = 1 << SHARED_BITS
#: Size of the table of hashed features.
TOKENS_A_ROW, MIN_BITS, MAX_BITS = 48, 16, 19
#: Sums of weights are held between these bounds.
Z_MAX = np.float32(40)
#: Buckets of the index over known words (by the first bits of their hashes).
INDEX_BITS = 20
#: Rows of the table that a task hands on together.
BLOCK = 1024
#: At most so many words' counts are broadcast; the others go through a join.
KNOWN_WORDS = 400_000
#: Stand-ins for the end token and for places before a text; bytes handled at once.
END_HASH, START_HASH = np.uint64(0xE17A1465F1A8D3B5), np.uint64(0x3C6EF372FE94F82B)
SLICE = 1 << 20
#: Training: rounds, bytes of a step, tokens that a task reads in a round, and the step
#: size. Every task hands on a table's changes, so their number sets what is shuffled.
ROUNDS = 2
STEP_BYTES = 1 << 16
TASK_TOKENS = 8_000_000
RATE = 0.25


def text_words(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows: (first row, words' offsets per row, 64-bit hash of every word)."""
    for lo, _, data, offsets in text_slices(column, limit):
        starts, ends, at = word_spans(data, offsets)
        rows = np.append(0, np.cumsum(np.diff(at) + 1))
        inner = np.ones(rows[-1], bool)
        inner[rows[1:] - 1] = False
        w = np.full(rows[-1], END_HASH, np.uint64)
        w[inner] = span_hashes(data, starts, ends)
        yield lo, rows, w


def count_words(texts: DataFrame) -> DataFrame:
    """(w, c) over all texts, pre-added inside each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, words in text_words(b.column(0), 4 * SLICE):
                w, c = np.unique(words, return_counts=True)
                yield pa.record_batch([pa.array(w.view(np.int64)), pa.array(c.astype(np.int64))], names=["w", "c"])

    return texts.select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def most_used(rows: DataFrame, count: str, most: int) -> pa.Table:
    """Rows whose count is at least a cut: the lowest cut (in eighths of a power
    of two) that at most ``most`` rows pass."""
    step = F.floor(F.log2(count) * 8)
    passing, cut = 0, None
    for r in sorted(rows.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        if passing + r["count"] > most:
            break
        passing, cut = passing + r["count"], r["step"]
    return (rows.where(step >= cut) if cut is not None else rows.limit(0)).toArrow()


@dataclass
class Classes:
    """The known words (hashes in order, counts, leaves) and the path of every leaf."""

    words: np.ndarray
    counts: np.ndarray
    leaves: np.ndarray
    own: int
    first: np.ndarray
    length: np.ndarray
    nodes: np.ndarray
    members: np.ndarray
    bias: np.ndarray
    shared_totals: np.ndarray

    def __post_init__(self) -> None:
        edges = np.arange(1 << INDEX_BITS, dtype=np.uint64) << np.uint64(64 - INDEX_BITS)
        self.bucket = np.append(np.searchsorted(self.words, edges), len(self.words)).astype(np.int32)

    def place(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of every word, and its place among the known words (-1: not known)."""
        leaf = self.own + (w >> np.uint64(64 - SHARED_BITS)).astype(np.int64)
        at = np.full(len(w), -1, np.int64)
        bucket = (w >> np.uint64(64 - INDEX_BITS)).astype(np.int64)
        place, end = self.bucket[bucket], self.bucket[bucket + 1]
        left = np.flatnonzero(place < end)
        while len(left):
            same = self.words[place[left]] == w[left]
            at[left[same]] = place[left[same]]
            left = left[~same]
            place[left] += 1
            left = left[place[left] < end[left]]
        known = at >= 0
        leaf[known] = self.leaves[at[known]]
        return leaf, at


def code_paths(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paths of the leaves of a 16-ary Huffman tree: (first step, number of steps) of
    every leaf, and (class, member) of every step."""
    heap = [(float(x), k) for k, x in enumerate(weights)]
    heap += [(0.0, -1)] * (-(len(heap) - 1) % (WAYS - 1))
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    node = 0
    while len(heap) > 1:
        total = 0.0
        for member in range(WAYS):
            weight, k = heapq.heappop(heap)
            total += weight
            if k >= 0:
                parent[k] = (node, member)
        heapq.heappush(heap, (total, len(weights) + node))
        node += 1
    first, length, nodes, members = [], [], [], []
    for k in range(len(weights)):
        first.append(len(nodes))
        while k in parent:
            nodes.append(parent[k][0])
            members.append(parent[k][1])
            k = len(weights) + parent[k][0]
        length.append(len(nodes) - first[-1])
    return tuple(np.array(x, np.int64) for x in (first, length, nodes, members))


def class_bias(weights: np.ndarray, first: np.ndarray, length: np.ndarray, nodes: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Logarithm of the members' shares of every class, from the weights of the leaves."""
    share = np.zeros((int(nodes.max(initial=0)) + 1, WAYS))
    np.add.at(share, (nodes, members), np.repeat(weights, length))
    share /= np.maximum(share.sum(1, keepdims=True), 1e-30)
    return np.log(np.maximum(share, 1e-13)).astype(np.float32)


def build_classes(counts: DataFrame) -> Classes:
    """Leaves and paths from the staged word counts. One row for each shared leaf and
    the known words reach the driver."""
    top = most_used(counts, "c", KNOWN_WORDS)
    w, c = top["w"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.lexsort((w, -c))
    w, c = w[order], c[order]
    own = min(len(w), OWN_LEAVES)
    leaf = F.shiftrightunsigned("w", 64 - SHARED_BITS)
    n, v = np.zeros(SHARED_LEAVES), np.zeros(SHARED_LEAVES)
    for r in counts.groupBy(leaf.cast("int").alias("leaf")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n[r["leaf"]], v[r["leaf"]] = r["n"], r["v"]
    shared = (w >> np.uint64(64 - SHARED_BITS)).astype(np.int64)
    n -= np.bincount(shared[:own], c[:own], SHARED_LEAVES)
    v -= np.bincount(shared[:own], minlength=SHARED_LEAVES)
    leaf_weights = np.concatenate([c[:own].astype(float), n + 1])
    paths = code_paths(leaf_weights)
    leaves = np.where(np.arange(len(w)) < own, np.arange(len(w)), own + shared)
    order = np.argsort(w)
    return Classes(w[order], c[order], leaves[order], own, *paths, class_bias(leaf_weights, *paths), np.log10(n + SMOOTH * (v + 1)))


def _histories(w: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Hashed features of the words before every word."""
    v = np.append(START_HASH, w[:-1])
    v[rows[:-1]] = START_HASH
    u = np.append(START_HASH, v[:-1])
    u[rows[:-1]] = START_HASH
    return [mix64(v + np.uint64(1)), mix64(u + np.uint64(2))]


def _choices(classes: Classes, w: np.ndarray, rows: np.ndarray, leaf: np.ndarray, bits: int
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Every choice on the words' paths: (word's place, member chosen, class, table
    rows of the features)."""
    size = classes.length[leaf]
    word = np.repeat(np.arange(len(w)), size)
    at = np.arange(len(word)) + np.repeat(classes.first[leaf] - (np.cumsum(size) - size), size)
    nodes = classes.nodes[at]
    node = mix64((nodes + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    shift = np.uint64(64 - bits)
    return word, classes.members[at], nodes, [((f[word] ^ node) * np.uint64(0xD6E8FEB86659FD93) >> shift).astype(np.int64)
                                              for f in _histories(w, rows)]


def _sums(classes: Classes, weights: np.ndarray, nodes: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    """Bias and weights of the features, added up for the members of every choice."""
    z = np.take(classes.bias, nodes, axis=0)
    for f in at:
        z += np.take(weights, f, axis=0)
    return np.clip(z, -Z_MAX, Z_MAX, out=z)


def table_bits(tokens: int) -> int:
    """log2 of the table's rows, from the number of training tokens."""
    return int(np.clip(round(np.log2(max(tokens, 1) / TOKENS_A_ROW)), MIN_BITS, MAX_BITS))


def round_tasks(tokens: int) -> int:
    """Tasks of a training round, which reads one part in ``ROUNDS`` of the tokens."""
    return max(1, -(-tokens // (ROUNDS * TASK_TOKENS)))


def train(texts: DataFrame, classes: Classes, tokens: int) -> np.ndarray:
    """Weights (table rows x 16) after all rounds."""
    spark = texts.sparkSession
    bits = table_bits(tokens)
    weights = np.zeros((1 << bits, WAYS), np.float32)
    square = np.zeros(1 << bits, np.float32)

    def learn(name: str, sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            classes, start, before = _unpacked(name, sent)
            mine, gain = start.copy(), before.copy()
            for b in batches:
                for _, rows, w in text_words(b.column(0), STEP_BYTES):
                    _descend(classes, mine, gain, w, rows, bits)
            gain -= before
            part = TaskContext.get().partitionId()
            for k in range(0, len(mine), BLOCK):
                if gain[k:k + BLOCK].any():
                    change = (mine[k:k + BLOCK] - start[k:k + BLOCK]).astype(np.float16)
                    yield pa.record_batch([pa.array([k // BLOCK], pa.int32()), pa.array([part], pa.int32()),
                                           pa.array([change.tobytes()], pa.binary()), pa.array([gain[k:k + BLOCK].tobytes()], pa.binary())],
                                          names=["block", "part", "change", "gain"])
        return run

    def average(block: pa.Table) -> pa.Table:
        total, gains = np.zeros((BLOCK, WAYS)), np.zeros(BLOCK)
        for k in np.argsort(block["part"].to_numpy()).tolist():
            gain = np.frombuffer(block["gain"][k].as_py(), np.float32).astype(float)
            total += gain[:, None] * np.frombuffer(block["change"][k].as_py(), np.float16).reshape(BLOCK, WAYS)
            gains += gain
        total /= np.maximum(gains, 1e-30)[:, None]
        return pa.table({"block": block["block"][:1], "change": pa.array([total.astype(np.float32).tobytes()], pa.binary()),
                         "gain": pa.array([gains.astype(np.float32).tobytes()], pa.binary())})

    schema = "block int, change binary, gain binary"
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(pickle.dumps((classes, weights, square)))
        mine = texts.where(F.pmod(text_key("text"), F.lit(ROUNDS)) == turn).select("text").coalesce(round_tasks(tokens))
        changes = mine.mapInArrow(learn(uuid.uuid4().hex, sent), "block int, part int, change binary, gain binary").groupBy("block").applyInArrow(average, schema)
        for r in changes.toArrow().to_pylist():
            lo = r["block"] * BLOCK
            weights[lo:lo + BLOCK] += np.frombuffer(r["change"], np.float32).reshape(BLOCK, WAYS)
            square[lo:lo + BLOCK] += np.frombuffer(r["gain"], np.float32)
        sent.unpersist()
    return weights


def _descend(classes: Classes, weights: np.ndarray, square: np.ndarray, w: np.ndarray, rows: np.ndarray, bits: int) -> None:
    """One AdaGrad step over a run of words, in place."""
    _, member, nodes, at = _choices(classes, w, rows, classes.place(w)[0], bits)
    if not len(member):
        return
    grad = np.exp(_sums(classes, weights, nodes, at))
    grad *= (-1 / grad.sum(1))[:, None]
    grad[np.arange(len(member)), member] += 1
    every = np.concatenate(at)
    order = np.argsort(every) if len(every) >> 32 else np.sort(every << 32 | np.arange(len(every))) & 0xFFFFFFFF
    every = every[order]
    new = np.append(True, every[1:] != every[:-1])
    alone = (new & np.append(new[1:], True))
    choice = order % len(member)
    first = np.flatnonzero(new)
    touched = every[first]
    summed = np.take(grad, choice[first], axis=0)
    if not alone.all():  # rows met more than once
        summed[~alone[first]] = np.add.reduceat(np.take(grad, choice[~alone], axis=0), np.flatnonzero(new[~alone]), axis=0)
    total = square[touched] + np.einsum("ij,ij->i", summed, summed)
    square[touched] = total
    summed *= (RATE * WAYS ** 0.5 / np.sqrt(total + 1e-6))[:, None]
    weights[touched] += summed


_UNPACKED: dict[str, tuple] = {}


def _unpacked(name: str, sent) -> tuple:
    """A worker unpacks a broadcast once; ``name`` is the broadcast's own."""
    if name not in _UNPACKED:
        _UNPACKED.clear()
        _UNPACKED[name] = pickle.loads(sent.value)
    return _UNPACKED[name]


def _score_rows(b: pa.RecordBatch, classes: Classes, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per text with the sums over its paths and known words, and one row per
    other distinct word of a text; a text's own row joins by a key of its own."""
    ids = b.column("doc_id")
    tkeys = b.column("tkey").to_numpy()
    bits = int(len(weights)).bit_length() - 1
    log_c = np.log10(classes.counts + SMOOTH)
    for lo, rows, w in text_words(b.column("text")):
        n = len(rows) - 1
        row = np.repeat(np.arange(n), np.diff(rows))
        leaf, at = classes.place(w)
        log_p = np.zeros(n)
        for s in range(0, len(w), 1 << 16):  # whole words only, histories reach back over the cut
            e, back = min(len(w), s + (1 << 16)), max(0, s - 2)
            cut = np.clip(rows, back, e) - back
            word, member, nodes, features = _choices(classes, w[back:e], np.unique(cut), leaf[back:e], bits)
            z = _sums(classes, weights, nodes, features)
            mine = word >= s - back
            each = z[np.arange(len(member)), member].astype(float) - np.log(np.exp(z).sum(1, dtype=float))
            log_p += np.bincount(row[back:e][word[mine]], each[mine], n)
        log_p /= np.log(10)
        shared = leaf >= classes.own
        log_p -= np.bincount(row[shared], classes.shared_totals[leaf[shared] - classes.own], n)
        found = at >= 0
        both = found & shared
        log_p += np.bincount(row[both], log_c[at[both]], n)
        sums = np.bincount(row[found], minlength=n), np.bincount(row[found], log_c[at[found]], n)
        rare = np.flatnonzero(~found)
        order = rare[np.lexsort((w[rare], row[rare]))]
        fresh = np.append(True, (w[order][1:] != w[order][:-1]) | (row[order][1:] != row[order][:-1]))[:len(order)]
        first = np.flatnonzero(fresh)
        times = np.diff(np.append(first, len(order)))
        place = np.append(np.arange(n), row[order[first]])
        own = mix64(tkeys[lo:lo + n].view(np.uint64) + np.uint64(1))
        pad = np.zeros(len(first), np.int64)
        yield pa.record_batch([
            pa.array(np.append(own, w[order[first]]).view(np.int64)), ids.take(pa.array(place + lo)), pa.array(tkeys[place + lo]),
            pa.array(np.append(np.zeros(n, np.int64), times)), pa.array(np.append(np.ones(n, np.int64), pad)),
            pa.array(np.append(np.diff(rows), pad)), pa.array(np.append(sums[0], pad)),
            pa.array(np.append(sums[1], pad.astype(float))), pa.array(np.append(log_p, pad.astype(float)))],
            names=["w", "doc_id", "tkey", "times", "rows", "n_tokens", "n_known", "log_c", "log_p"])


def fit(texts: DataFrame) -> tuple[Classes, np.ndarray, DataFrame, int, float]:
    """(classes, weights, staged word counts, training tokens, log10 of the base's divisor)."""
    counts = stage(count_words(texts), "lm-counts")
    n, v = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n = n or 0
    classes = build_classes(counts)
    return classes, train(texts, classes, n), counts, n, float(np.log10(n + SMOOTH * (v + 1)))


def score_texts(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every
    row, learned from the rows where ``training`` holds."""
    classes, weights, counts, n, base = fit(docs.where(training))
    name, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(pickle.dumps((classes, weights)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _score_rows(b, *_unpacked(name, sent))

    parts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_key("text").alias("tkey"), "text").mapInArrow(
        run, "w long, doc_id string, tkey long, times long, rows long, n_tokens long, n_known long, log_c double, log_p double")
    joined = parts.join(counts, "w", "left")
    rare = F.when(F.col("rows") == 0, F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).otherwise(0.0)
    known = F.when((F.col("rows") == 0) & (F.col("c") > 0), F.col("times")).otherwise(0)
    summed = joined.groupBy("doc_id", "tkey").agg(
        F.sum("rows").alias("rows"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + known).alias("n_known"),
        F.sum(F.col("log_c") + rare).alias("log_c"), F.sum(F.col("log_p") + rare).alias("log_p"))
    one = summed.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    kind = docs.schema["doc_id"].dataType
    n_tokens = (F.col("n_tokens") / F.col("rows")).cast("long")
    return one.select(F.col("doc_id").cast(kind).alias("doc_id"), n_tokens.alias("n_tokens"),
                      (F.col("n_known") / F.col("rows")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                      (F.col("log_c") / F.col("rows") - n_tokens * F.lit(base)).alias("base_score"),
                      (F.col("log_p") / F.col("rows")).alias("score"))


def op4_lm_score(docs: DataFrame) -> DataFrame:
    """Contract columns."""
    held_out = fold_remainder("doc_id", 10) == 0
    scored = score_texts(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
