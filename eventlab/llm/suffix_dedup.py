"""Repeated passages by sparse suffix arrays.

Texts are sequences of words (A-Z folded). Of all suffixes only those at
content-selected positions are kept: in every window of ``L - K + 1`` runs of K
words the run of smallest hash, so equal windows of L words keep the same
positions. Suffixes whose run occurs in one text only are dropped. The others
are sorted by their next L words over range partitions; each is compared with
its neighbours of other texts, and the match is extended to the right and to the
left. Matches of at least L words are spans; spans of a text that touch are one.

A neighbour is the nearest suffix of another text, however many of its own text lie
between. Those in other partitions are found through the partitions' edge rows, so a
passage that a third of all texts hold is split over many tasks.

The nearest suffix has the longest match to the right, but one further away may
share more to the left. So where windows of L words have a shared position and are
in no span yet, all windows around positions of that code are compared, by 128-bit
hashes of their words: a window that another text has is a span. With them every
repeated window is found.

Repeats count across documents: texts that are equal are one text (all of it is
a span if it has L words and two ids), repeats inside one text only are none.

Defined cases: null texts and texts of fewer than L words have no spans; rows
that repeat an id and text are one document; null ids count as one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlab.llm.common import MAX_BROADCAST_ROWS, WORD, mix64, null_safe, small_side, text_key, text_slices, word_hashes
from eventlab.sources.files import stage

#: Words of a passage, and of the run that selects positions.
MIN_WORDS = 50
RUN = 12
_BITS = np.uint64(24)


def anchors(words: np.ndarray, rows: np.ndarray, length: int = MIN_WORDS, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """(word position in the slice, hash of its run) of the selected positions."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    n = len(words) - run + 1
    window = length - run + 1
    if n < window:
        return none
    code = _runs(words, run)
    # hash above, position below: the minimum of a window is its leftmost smallest run
    least = (code >> _BITS << _BITS) | np.arange(n, dtype=np.uint64)
    have = 1
    while have * 2 <= window:
        least = np.minimum(least[:len(least) - have], least[have:])
        have *= 2
    if have < window:
        least = np.minimum(least[:len(least) - (window - have)], least[window - have:])
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    inside = row[:len(least)] == row[length - 1:length - 1 + len(least)]
    at = np.unique(least[inside] & ((np.uint64(1) << _BITS) - np.uint64(1))).astype(np.int64)
    return at, code[at]


def _runs(words: np.ndarray, run: int) -> np.ndarray:
    n = len(words) - run + 1
    code = np.zeros(max(n, 0), np.uint64)
    for k in range(run if n > 0 else 0):
        code += mix64(words[k:n + k] * np.uint64((2 * k + 3) * 0xD1342543DE82EF95 % 2**64 | 1))
    return mix64(code)


def window_choices(words: np.ndarray, length: int, run: int) -> np.ndarray:
    """The selected position of every window of ``length`` words of one text."""
    n, window = len(words) - run + 1, length - run + 1
    if n < window:
        return np.zeros(0, np.int64)
    least = (_runs(words, run) >> _BITS << _BITS) | np.arange(n, dtype=np.uint64)
    have = 1
    while have * 2 <= window:
        least = np.minimum(least[:len(least) - have], least[have:])
        have *= 2
    if have < window:
        least = np.minimum(least[:len(least) - (window - have)], least[window - have:])
    return (least & ((np.uint64(1) << _BITS) - np.uint64(1))).astype(np.int64)


def window_hashes(words: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the windows of ``length`` words at ``starts``."""
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        total = np.zeros(len(starts), np.uint64)
        each = mix64(words ^ np.uint64(salt))
        for k in range(length):
            total = total * np.uint64(0xD6E8FEB86659FD93) + each[starts + k]
        out.append(mix64(total).view(np.int64))
    return out[0], out[1]


def _windows(texts: DataFrame, length: int, run: int) -> DataFrame:
    """(w1, w2, tkey, start, code) of the windows of ``texts`` (tkey, text, positions,
    and spans as starts and ends, sorted, or null) whose selected position is listed
    and that lie in no span."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [b.column(k).to_pylist() for k in (3, 4)]
            for k, (key, text, positions) in enumerate(zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist())):
                raw = np.frombuffer(text.as_buffer(), np.uint8) if text.as_buffer() else np.zeros(0, np.uint8)
                words, _ = word_hashes(raw, np.array([0, len(raw)]))
                codes, chosen = _runs(words, run), window_choices(words, length, run)
                mine = np.isin(chosen, positions)
                begin, end = (np.array(s[k] or [], np.int64) for s in spans)
                at = np.searchsorted(begin, np.arange(len(chosen)), "right") - 1
                inside = np.zeros(len(chosen), bool)
                if len(begin):
                    inside = (at >= 0) & (end[np.maximum(at, 0)] >= np.arange(len(chosen)) + length)
                starts = np.flatnonzero(mine & ~inside)
                for lo in range(0, len(starts), 100_000):
                    part = starts[lo:lo + 100_000]
                    w1, w2 = window_hashes(words, part, length)
                    yield pa.record_batch([pa.array(w1), pa.array(w2), pa.array(np.full(len(part), key, np.int64)), pa.array(part.astype(np.int32)),
                                           pa.array(codes[chosen[part]].view(np.int64))], names=["w1", "w2", "tkey", "start", "code"])

    return texts.mapInArrow(go, "w1 long, w2 long, tkey long, start int, code long")


def _joined_spans(matches: DataFrame) -> DataFrame:
    """(tkey, start_word, end_word): spans of a text that touch as one."""
    order = Window.partitionBy("tkey").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (matches.withColumn("fresh", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
            .withColumn("part", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("tkey", "part").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word")).drop("part"))


#: Parts of a code that more texts share than a broadcast list of codes allows for.
SALTS = 16


def selected_positions(docs: DataFrame, length: int = MIN_WORDS, run: int = RUN) -> DataFrame:
    """(code, tkey, pos) of every text's selected positions."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_numpy()
            for lo, _, data, offsets in text_slices(b.column(1)):
                words, rows = word_hashes(data, offsets)
                at, code = anchors(words, rows, length, run)
                row = np.searchsorted(rows, at, "right") - 1
                yield pa.record_batch([pa.array(code.view(np.int64)), pa.array(keys[lo + row]),
                                       pa.array((at - rows[row]).astype(np.int32))], names=["code", "tkey", "pos"])

    texts = docs.where("text is not null").select(text_key("text").alias("tkey"), "text")
    return texts.mapInArrow(go, "code long, tkey long, pos int")


def _suffixes(texts: DataFrame, length: int, run: int) -> DataFrame:
    """(right, left, tkey, pos): the next and (from the position backwards) the
    previous words of each position that ``texts`` (tkey, text, positions) lists."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            right, left, tkey, at = [], [], [], []
            for key, text, positions in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                words = text.as_py().encode().lower().split()
                for p in positions:
                    right.append(b" ".join(words[p:p + length]))
                    left.append(b" ".join(words[max(0, p - length + run):p][::-1]))
                    tkey.append(key)
                    at.append(p)
                if len(at) > 20_000:
                    yield _rows(right, left, tkey, at)
                    right, left, tkey, at = [], [], [], []
            yield _rows(right, left, tkey, at)

    def _rows(right, left, tkey, at) -> pa.RecordBatch:
        return pa.record_batch([pa.array(right, pa.binary()), pa.array(left, pa.binary()), pa.array(tkey, pa.int64()),
                                pa.array(at, pa.int32())], names=["right", "left", "tkey", "pos"])

    return texts.mapInArrow(go, "right binary, left binary, tkey long, pos int")


def _common(a: bytes, b: bytes) -> int:
    """Words that two texts begin with alike."""
    if a == b:
        return a.count(b" ") + 1 if a else 0
    n = 0
    for x, y in zip(a.split(), b.split()):
        if x != y:
            break
        n += 1
    return n


class _Spans:
    """Matches found in one task, as columns."""

    def __init__(self, length: int):
        self.length = length
        self.rows: dict[tuple[int, int, int], None] = {}

    def compare(self, p: tuple, q: tuple) -> None:
        right = _common(p[0], q[0])
        if not right:
            return
        left = _common(p[1], q[1])
        if left + right >= self.length:
            for x in (p, q):
                self.rows[x[2], x[3] - left, x[3] + right] = None

    def meet(self, run: dict[tuple[bytes, bytes], list[int]], tkey: int, q: tuple) -> None:
        """Compares the rows of one text with a row of another."""
        for (right, left), positions in run.items():
            r, l = _common(right, q[0]), _common(left, q[1])
            if r and l + r >= self.length:
                self.rows[q[2], q[3] - l, q[3] + r] = None
                for p in positions:
                    self.rows[tkey, p - l, p + r] = None

    def batch(self, edges: list[tuple] = (), piece: int = 0) -> pa.RecordBatch:
        """Spans have no edge; edges are (kind, row) of a piece."""
        s = list(self.rows)
        self.rows = {}
        return pa.record_batch([
            pa.array([x[0] for x in s] + [e[2] for _, e in edges], pa.int64()),
            pa.array([x[1] for x in s] + [e[3] for _, e in edges], pa.int32()),
            pa.array([x[2] for x in s] + [None] * len(edges), pa.int32()),
            pa.array([None] * len(s) + [k for k, _ in edges], pa.int32()),
            pa.array([None] * len(s) + [piece] * len(edges), pa.int32()),
            pa.array([None] * len(s) + [e[0] for _, e in edges], pa.binary()),
            pa.array([None] * len(s) + [e[1] for _, e in edges], pa.binary())],
            names=["tkey", "start", "end", "edge", "piece", "right", "left"])


#: Edge rows: of the first run of a partition, of its last run; its first row and
#: the first of another text, its last row and the last of another text.
LEADING, TRAILING, FIRST, FIRST_OTHER, LAST, LAST_OTHER = range(6)
_SPAN_SCHEMA = "tkey long, start int, end int, edge int, piece int, right binary, left binary"


def _neighbours(sorted_suffixes: DataFrame, length: int) -> DataFrame:
    """Spans of each suffix and the nearest ones of another text before and after
    it inside its partition, and the partition's edge rows. A run (adjacent rows
    of one text) is held as a whole, its equal rows as one with their positions."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        spans = _Spans(length)
        first = first_other = before = last = None  # before: the last row of the text before the current run
        run: dict[tuple[bytes, bytes], list[int]] = {}
        open_rows = lambda kind: [(kind, (*k, last[2], p)) for k, at in run.items() for p in at]
        edges: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(4))):
                first = first or row
                if last is not None and row[2] != last[2]:
                    spans.meet(run, last[2], row)
                    if first_other is None:
                        first_other = row
                        edges = open_rows(LEADING)
                    before, run = last, {}
                elif before is not None:
                    spans.compare(before, row)
                run.setdefault(row[:2], []).append(row[3])
                last = row
            yield spans.batch()
        if first is not None:
            edges += open_rows(TRAILING) + (open_rows(LEADING) if first_other is None else [])
            edges += [(k, r) for k, r in ((FIRST, first), (FIRST_OTHER, first_other), (LAST, last), (LAST_OTHER, before)) if r]
            piece = TaskContext.get().partitionId()
            for lo in range(0, len(edges), 20_000):
                yield spans.batch(edges[lo:lo + 20_000], piece)

    return sorted_suffixes.mapInArrow(go, _SPAN_SCHEMA)


def _carried(rows: dict[int, dict[int, tuple]], pieces: list[int], kinds: tuple[int, int]) -> dict[int, list[tuple]]:
    """For every piece the nearest row of the pieces gone through before it, and the
    nearest of another text than that row."""
    out: dict[int, list[tuple]] = {}
    have: list[tuple] = []
    for piece in pieces:
        out[piece] = have
        near = [rows[piece][k] for k in kinds if k in rows[piece]] + have
        have = near[:1] + [r for r in near if r[2] != near[0][2]][:1]
    return out


def _across_edges(edges: DataFrame, length: int) -> DataFrame:
    """Spans between the first and last run of each partition and the nearest
    suffixes of another text in the partitions before and after. At most four rows
    a partition reach the driver."""
    columns = ["right", "left", "tkey", "start"]
    rows: dict[int, dict[int, tuple]] = {}
    for r in edges.where(F.col("edge") >= FIRST).collect():
        rows.setdefault(r["piece"], {})[r["edge"]] = tuple(bytes(r[c]) if c in ("right", "left") else r[c] for c in columns)
    pieces = sorted(rows)
    sent = edges.sparkSession.sparkContext.broadcast({
        LEADING: _carried(rows, pieces, (LAST, LAST_OTHER)), TRAILING: _carried(rows, pieces[::-1], (FIRST, FIRST_OTHER))})

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = _Spans(length)
        for b in batches:
            for edge, piece, *row in zip(*(b.column(k).to_pylist() for k in range(6))):
                other = next((r for r in sent.value[edge][piece] if r[2] != row[2]), None)
                if other is not None:
                    spans.compare(tuple(row), other)
            yield spans.batch()

    return edges.where(F.col("edge") < FIRST).select("edge", "piece", *columns).mapInArrow(go, _SPAN_SCHEMA)


def repeated_spans(docs: DataFrame, length: int = MIN_WORDS, run: int = RUN) -> DataFrame:
    """(doc_id, start_word, end_word): passages of at least ``length`` words that
    another document holds too; the end is exclusive."""
    spark = docs.sparkSession
    slim = docs.where("text is not null").select("doc_id", text_key("text").alias("tkey"),
                                                 F.regexp_count("text", F.lit(WORD)).alias("n_words"))
    slim = stage(slim.distinct(), "suffix-documents")
    copies = slim.groupBy("tkey", "n_words").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("ids"))
    chosen = stage(selected_positions(docs, length, run), "suffix-positions")
    shared = (chosen.groupBy("code").agg(F.min("tkey").alias("lo"), F.max("tkey").alias("hi"))
              .where("lo <> hi").select("code"))
    shared = stage(shared, "suffix-codes")
    few = shared.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    if few:
        chosen = chosen.join(F.broadcast(shared), "code")
    else:  # a code that most texts hold is met in parts
        salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        chosen = chosen.withColumn("salt", F.pmod("tkey", F.lit(SALTS)).cast("int")).join(salted, ["code", "salt"])
    positions = chosen.groupBy("tkey").agg(F.sort_array(F.collect_set("pos")).alias("positions"))
    # one document stands for each text
    wanted = positions.join(copies.select("tkey", "doc_id"), "tkey")
    wanted = stage(wanted, "suffix-wanted")
    keyed = docs.where("text is not null").select("doc_id", "text", text_key("text").alias("tkey"))
    texts = null_safe(keyed, wanted.select("doc_id", "tkey", "positions"), ["doc_id", "tkey"]).select(
        "tkey", "text", "positions")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (_suffixes(texts, length, run).repartitionByRange(parts, "right", "tkey", "pos")
               .sortWithinPartitions("right", "tkey", "pos"))
    found = stage(_neighbours(ordered, length), "suffix-spans")
    matches = found.where("edge is null").unionByName(_across_edges(found.where("edge is not null"), length))
    whole = copies.where((F.col("ids") > 1) & (F.col("n_words") >= length)).select(
        "tkey", F.lit(0).alias("start"), F.col("n_words").alias("end"))
    matches = matches.select("tkey", "start", "end").unionByName(whole).distinct()
    spans = stage(_joined_spans(matches), "suffix-joined")

    held = spans.groupBy("tkey").agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("spans"))

    def windows_of(asked: DataFrame) -> DataFrame:
        met = null_safe(keyed, asked, ["doc_id", "tkey"])
        return _windows(met.select("tkey", "text", "positions", "starts", "ends"), length, run)

    asked = wanted.join(held, "tkey", "left").select("doc_id", "tkey", "positions", F.col("spans.start_word").alias("starts"),
                                                     F.col("spans.end_word").alias("ends"))
    codes = stage(windows_of(asked).select("code").distinct(), "suffix-open")
    around = (chosen.join(small_side(codes), "code").groupBy("tkey").agg(F.collect_set("pos").alias("positions"))
              .join(copies.select("tkey", "doc_id"), "tkey"))
    none = F.lit(None).cast("array<int>")
    windows = stage(windows_of(around.withColumns({"starts": none, "ends": none})), "suffix-windows")
    again = stage(windows.groupBy("w1", "w2").agg(F.min("tkey").alias("lo"), F.max("tkey").alias("hi")).where("lo <> hi")
                  .select("w1", "w2"), "suffix-repeated")
    more = windows.join(small_side(again), ["w1", "w2"]).select("tkey", "start", (F.col("start") + length).alias("end"))
    every = spans.select("tkey", F.col("start_word").alias("start"), F.col("end_word").alias("end")).unionByName(more)
    return slim.join(_joined_spans(every), "tkey").select("doc_id", "start_word", "end_word")


def op5_suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row per repeated passage of a document."""
    return repeated_spans(docs)
