"""Language identification by multilingual mixture inference.

Each learned language has a smoothed distribution over hashed runs of
``GRAM`` bytes of lower-cased text in which everything but letters is one
space. A document is a mixture of those distributions and one uniform noise
part; expectation-maximisation estimates its proportions. Languages enter the
document's set in the order of their proportions as long as the likelihood,
less ``PENALTY`` * log(runs) for each one more, grows. The prediction is the
set's language of highest proportion, the score that proportion (noise counts,
so text that fits no language scores low).

Defined cases: a null text or one without a letter is ``und`` with score 0, as
is every text if no language was learned. Ties go to the language that sorts
first. Null languages and null texts are not learned from; repeated rows count
as often as they occur.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from eventlab.llm.common import fold_remainder

#: Bytes in a run; hash buckets; smoothing count per bucket.
GRAM = 4
BUCKETS = 1 << 15
ALPHA = 0.1
#: EM steps over all languages, and over each tried set.
STEPS = 8
SET_STEPS = 5
PENALTY = 4.0
#: Languages below this proportion are not tried.
LEAST_SHARE = 0.01
UNKNOWN = "und"
#: Bytes of text handled at once.
SLICE = 1 << 20

_TABLE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the distinct runs of each text; runs that are
    only space don't count."""
    raw = [b" " + t.lower().encode().translate(_TABLE) + b" " for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8)
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    space = data == 32
    row = np.repeat(np.arange(len(raw)), size)
    # one space between words
    keep = ~(space & np.append(False, space[:-1]))
    keep[np.cumsum(size)[:-1]] = True
    data, row = data[keep], row[keep]
    # a single byte between spaces gets one more space, so that it has a run
    short = np.bincount(row, minlength=len(raw)) == GRAM - 1
    if short.any():
        ends = np.searchsorted(row, np.flatnonzero(short), "right")
        data, row = np.insert(data, ends, 32), np.insert(row, ends, np.flatnonzero(short))
    if len(data) < GRAM:
        return (np.zeros(0, np.int64),) * 3
    n = len(data) - GRAM + 1
    code = np.zeros(n, np.uint32)
    for k in range(GRAM):
        code = (code << np.uint32(8)) | data[k:n + k]
    inside = row[:n] == row[GRAM - 1:]
    code, row = code[inside], row[:n][inside]
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)
    key = row.astype(np.int64) * BUCKETS + bucket
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    return key[first] // BUCKETS, key[first] % BUCKETS, count


def _runs(texts: list[str | None], limit: int = SLICE) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > limit:
            yield lo, k
            lo, size = k, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


def learn(docs: DataFrame, training: Column) -> tuple[list[str], np.ndarray]:
    """Languages in sorted order and their log-free distributions
    [BUCKETS, languages + 1]; the last column is the noise part. Only one
    number per language and bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in _runs(texts):
                row, bucket, count = gram_counts(texts[lo:hi])
                names = sorted(set(langs[lo:hi]))
                code = np.array([names.index(x) for x in langs[lo:hi]])
                sums = np.bincount(code[row] * BUCKETS + bucket, weights=count, minlength=len(names) * BUCKETS)
                for k, name in enumerate(names):
                    total[name] = total.get(name, 0) + sums[k * BUCKETS:(k + 1) * BUCKETS]
        for name, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.record_batch({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()),
                                   "n": pa.array(sums[at].astype(np.int64))})

    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = (rows.mapInArrow(run, "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    langs = sorted(set(counts["lang"].to_pylist()))
    table = np.full((BUCKETS, len(langs) + 1), ALPHA)
    if langs:
        code = {x: k for k, x in enumerate(langs)}
        at = np.array([code[x] for x in counts["lang"].to_pylist()])
        table[counts["bucket"].to_numpy(), at] += counts["n"].to_numpy()
    return langs, (table / table.sum(0)).astype(np.float32)


def _em(parts: np.ndarray, count: np.ndarray, row: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood per document; zero shares stay zero."""
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    for _ in range(steps):
        part = parts * share[row]
        share = np.add.reduceat(part * (count / part.sum(1))[:, None], first)
        share = share / share.sum(1, keepdims=True)
    fit = np.add.reduceat(count * np.log((parts * share[row]).sum(1)), first)
    return share, fit


def infer(texts: list[str], langs: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    row, bucket, count = gram_counts(texts)
    known = np.array([bool(_LETTER.search(t)) for t in texts], bool)
    ok = known[row]
    row, bucket, count = row[ok], bucket[ok], count[ok].astype(np.float32)
    if not len(row) or not langs:
        return out, score
    docs, row = np.unique(row, return_inverse=True)
    parts = table[bucket]
    k = len(langs)
    share, _ = _em(parts, count, row, np.full((len(docs), k + 1), 1 / (k + 1), np.float32), STEPS)
    runs = np.bincount(row, weights=count)
    order = np.argsort(-share[:, :k], axis=1, kind="stable")
    best_share = np.zeros_like(share)
    best = np.full(len(docs), -np.inf)
    trying = np.arange(len(docs))
    for m in range(1, k + 1):
        entries = np.isin(row, trying) if len(trying) < len(docs) else slice(None)
        sub = np.searchsorted(trying, row[entries])
        start = np.zeros((len(trying), k + 1), np.float32)
        np.put_along_axis(start, order[trying, :m], 1.0, 1)
        start[:, k] = 0.05
        start *= np.maximum(share[trying], 1e-3)
        start /= start.sum(1, keepdims=True)
        got, fit = _em(parts[entries], count[entries], sub, start, SET_STEPS)
        gain = fit - PENALTY * (m - 1) * np.log(np.maximum(runs[trying], 2)) > best[trying]
        trying, got, fit = trying[gain], got[gain], fit[gain]
        best[trying] = fit - PENALTY * (m - 1) * np.log(np.maximum(runs[trying], 2))
        best_share[trying] = got
        if m < k:
            trying = trying[np.take_along_axis(share[trying], order[trying, m:m + 1], 1)[:, 0] > LEAST_SHARE]
        if not len(trying):
            break
    top = best_share[:, :k].argmax(1)
    for d, t, s in zip(docs.tolist(), top.tolist(), best_share[np.arange(len(docs)), top].tolist()):
        out[d] = langs[t]
        score[d] = min(1.0, max(0.0, s))
    return out, score


def _predicted(docs: DataFrame, training: Column, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row as k0, k1 ..., ``lang_pred`` and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(learn(docs, training)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = pickle.loads(sent.value)
        for b in batches:
            step = max(1, min(b.num_rows, (16 << 20) * b.num_rows // max(b.nbytes, 1)))
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                texts = [t or "" for t in part.column(len(keep)).to_pylist()]
                found: list[str] = []
                score: list[float] = []
                for a, z in _runs(texts):
                    names, s = infer(texts[a:z], langs, table)
                    found += names
                    score += s.tolist()
                yield pa.record_batch([*part.columns[:len(keep)], pa.array(found, pa.string()),
                                       pa.array(score, pa.float64())], schema=schema)

    schema = pa.schema([*(pa.field(f"k{i}", to_arrow_type(docs.schema[c].dataType)) for i, c in enumerate(keep)),
                        pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())])
    ddl = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)),
                     "lang_pred string", "score double"])
    return docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col("text").alias("_text")).mapInArrow(run, ddl)


def predict(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, ``lang_pred`` and ``score`` of every row; learned from the rows
    where ``training`` holds."""
    return _predicted(docs, training, ["doc_id"]).withColumnRenamed("k0", "doc_id")


def op7_language(docs: DataFrame) -> DataFrame:
    """Contract columns."""
    held_out = fold_remainder("doc_id", 3) == 1
    found = predict(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.2) -> DataFrame:
    """Documents with an identified language, columns as given: those without a
    letter and those of which no language explains the share ``least`` go."""
    found = _predicted(docs, ~(fold_remainder("doc_id", 3) == 1), docs.columns)
    stays = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return stays.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)))
