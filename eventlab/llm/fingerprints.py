"""Document fingerprints by a homomorphic multiset hash.

Every paragraph (line) is hashed to a wide vector: four 64-bit lanes that
identify it and ``LANES`` signed lanes that hold its runs of ``WORDS`` words.
A document's fingerprint is the sum of its paragraphs' vectors, modulo 2^64 in
the first four lanes and 2^32 in the others. Order doesn't matter, and adding
or subtracting a paragraph's vector inserts or deletes it.

The likeness of two fingerprints is 1 if they are equal, else the cosine of the
signed lanes (0 where negative), which estimates the share of common word runs.

Defined cases: null and empty texts have one empty paragraph; the likeness of
two texts without words is 1 only if the fingerprints are equal. Rows are
ordered by doc_id (null last), equal ids by text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from eventlab.llm.common import shingle_hashes, text_slices, word_hashes

#: Signed lanes for likeness; identity lanes; words in a run.
LANES = 128
IDENTITY = 4
WORDS = 3
_SEEDS = np.random.default_rng(10).integers(1, 2**63, IDENTITY, dtype=np.uint64)


def _paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every line, and the row it belongs to."""
    breaks = np.flatnonzero(data == 10)
    row_of_break = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    row = np.concatenate([np.arange(len(offsets) - 1), row_of_break])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    last = np.append(row[1:] != row[:-1], True)
    ends[last] = offsets[row[last] + 1]
    return starts, ends, row


def _exact_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """IDENTITY lanes per span from a 256-bit digest of its bytes (case kept)."""
    raw = data.tobytes()
    digests = b"".join(hashlib.blake2b(raw[s:e], digest_size=8 * IDENTITY).digest()
                       for s, e in zip(starts.tolist(), ends.tolist()))
    return np.frombuffer(digests, np.uint64).reshape(-1, IDENTITY)


def paragraph_sums(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(identity sums, lane sums) of each row; both wrap around."""
    n = len(offsets) - 1
    starts, ends, row = _paragraphs(data, offsets)
    first = np.searchsorted(row, np.arange(n))
    identity = np.add.reduceat(_exact_hashes(data, starts, ends), first, axis=0)
    # a paragraph's word runs stay inside it, so its vector depends on it alone
    words, rows = word_hashes(data, np.append(starts, offsets[-1]))
    runs, paragraph = shingle_hashes(words, rows, WORDS)
    lane = (runs % np.uint64(LANES)).astype(np.int64)
    sign = np.where((runs >> np.uint64(40)) & np.uint64(1), 1, -1)
    lanes = np.bincount(row[paragraph] * LANES + lane, weights=sign, minlength=n * LANES)
    return identity, lanes.reshape(n, LANES).astype(np.int64).astype(np.uint32)


def likeness(a_id: np.ndarray, a: np.ndarray, b_id: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for rows of fingerprints a and b."""
    equal = (a_id == b_id).all(1) & (a == b).all(1)
    x, y = a.view(np.int32).astype(float), b.view(np.int32).astype(float)
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cos = np.divide((x * y).sum(1), norm, out=np.zeros(len(x)), where=norm > 0)
    return np.where(equal, 1.0, np.clip(cos, 0.0, 1.0))


def encode(identity: np.ndarray, lanes: np.ndarray) -> list[str]:
    return [base64.b64encode(i.astype("<u8").tobytes() + v.astype("<u4").tobytes()).decode()
            for i, v in zip(identity, lanes)]


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[:8 * IDENTITY], "<u8"), np.frombuffer(raw[8 * IDENTITY:], "<u4")


def combine(fingerprint: str, added: str, sign: int = 1) -> str:
    """Insert (1) or delete (-1) the paragraphs that ``added`` stands for."""
    a, b = decode(fingerprint), decode(added)
    with np.errstate(over="ignore"):
        both = [x + y if sign > 0 else x - y for x, y in zip(a, b)]
    return encode(both[0][None], both[1][None])[0]


def fingerprint_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [paragraph_sums(data, offsets) for _, _, data, offsets in text_slices(column)]
    if not parts:
        return np.zeros((0, IDENTITY), np.uint64), np.zeros((0, LANES), np.uint32)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"doc_id": b.column(0), "fingerprint": pa.array(
                encode(*fingerprint_texts(b.column(1))), pa.string())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string")


def in_ranges(docs: DataFrame, pieces: int) -> DataFrame:
    """(piece, ghost, doc_id, text): documents in ``pieces`` ranges of doc_id,
    each range ending with a ghost of the document that follows its last one
    (after the very last: the first). Only the bounds of the ranges, ``pieces``
    numbers, pass through the driver."""
    slim = docs.select("doc_id")
    bounds = slim.where(F.col("doc_id").isNotNull()).approxQuantile(
        "doc_id", [k / pieces for k in range(1, pieces)], 0.1 / pieces)
    bounds = sorted({int(x) for x in bounds})
    piece = F.lit(0)
    if bounds:
        piece = F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(
            F.aggregate(F.lit(bounds), F.lit(0), lambda n, b: n + (F.col("doc_id") >= b).cast("int")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("piece", piece)
    firsts = (rows.groupBy("piece").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))["doc_id"]
                                        .alias("first_id"))
              .orderBy("piece").limit(len(bounds) + 2).collect())
    before = {r["piece"]: firsts[k - 1]["piece"] for k, r in enumerate(firsts)}
    ids = [r["first_id"] for r in firsts]
    if not firsts:
        return rows.select("piece", F.lit(0).alias("ghost"), "doc_id", "text")
    back = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    known = [i for i in ids if i is not None]
    is_first = F.col("doc_id").isin(known) if known else F.lit(False)
    if None in ids:
        is_first = is_first | F.col("doc_id").isNull()
    # equal ids: the smallest text comes first
    heads = (rows.where(is_first).groupBy("piece", "doc_id").agg(F.min("text").alias("text"))
             .select(back[F.col("piece")].alias("piece"), F.lit(1).alias("ghost"), "doc_id", "text"))
    return rows.select("piece", F.lit(0).alias("ghost"), "doc_id", "text").unionByName(heads)


def _edited(texts: list[str], following: list[str]) -> list[str]:
    out = []
    for t, u in zip(texts, following):
        half = len(t) // 2
        out.append(t[:len(t) - half] + u[:half])
    return out


def op10_fingerprints(docs: DataFrame) -> DataFrame:
    """Contract columns: the documents, sorted inside ranges, stream past their
    successors; whole texts are shuffled once."""
    spark = docs.sparkSession
    pieces = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str], list[str]]]:
        held = None  # the last document of the rows so far, which waits for its successor
        for b in batches:
            step = max(1, min(2000, (8 << 20) * max(b.num_rows, 1) // max(b.nbytes, 1)))
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                rows = [*([held] if held else []), *zip(*(part.column(k).to_pylist() for k in range(4)))]
                real = [k for k in range(len(rows) - 1) if not rows[k][1]]
                if real:
                    yield ([rows[k][2] for k in real], [rows[k][3] for k in real],
                           [rows[k + 1][3] for k in real])
                held = None if rows[-1][1] else rows[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, following in pairs(batches):
            edited = _edited(texts, following)
            a = fingerprint_texts(pa.array(texts, pa.large_string()))
            e = fingerprint_texts(pa.array(edited, pa.large_string()))
            f = fingerprint_texts(pa.array(following, pa.large_string()))
            yield pa.record_batch({
                "doc_id": pa.array(ids, id_type),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                "fingerprint": pa.array(encode(*a), pa.string()),
                "edited_fingerprint": pa.array(encode(*e), pa.string()),
                "near_edited": pa.array(likeness(*a, *e)), "near_next": pa.array(likeness(*a, *f))})

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = (in_ranges(docs, pieces).repartition("piece")
               .sortWithinPartitions("piece", "ghost", F.col("doc_id").asc_nulls_last(), "text"))
    return ordered.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                                   "edited_fingerprint string, near_edited double, near_next double")
