"""Ranked lexical search over bit-sliced Bloom signatures.

Index: every document is a Bloom signature of its terms. A term that occurs tf
times is entered once for each of ``LEVELS`` up to tf, so a signature also bounds
counts from above. ``ROWS`` documents of one signature width form a block; the
block keeps, for each signature bit, one word whose bits are the documents
(a slice). The width follows the number of entries, so short and long documents
don't share blocks.

Search, for a block of queries:

1. One pass over the texts counts documents, terms and the documents that hold
   each query term; these give the terms' weights.
2. The AND of a term's slices says which documents of a block may hold it, with
   false positives only. Sums of the slices weighted by the terms' weights, taken
   level by level, and a document's length give an upper bound of its score.
3. The ``FIRST * k`` documents with the highest bounds are scored exactly; a
   query's k-th best of these scores is a score that its results reach.
4. Every document whose bound reaches that score is scored exactly on its whole
   text; the others are provably outside the k best.

So results are exact whatever the signatures' false positives; very long texts
whose signature is overfull only get looser bounds.

Terms are told apart by 64-bit hashes of their bytes (A-Z lowered). Queries are
taken in blocks of at most ``BLOCK_TERMS`` terms, one after the other; only a
block's terms, weights and reached scores pass the driver.

Defined cases: null and empty texts have no terms and are never ranked; rows with
a null doc_id count in the statistics and are not ranked; rows that repeat a
doc_id are documents of their own; items that share an id are one query with the
terms of all their texts; items without an id or terms, and items that no document
scores above 0 for, have no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlab.llm.common import light_side, mix64, null_safe, span_hashes, text_key, text_slices, word_spans
from eventlab.sources.files import stage

#: Documents of a block: the bits of one word.
ROWS = 64
#: Signature bits for each entry (at least; widths are powers of two), probes of an entry.
BITS, PROBES = 16, 8
#: Logarithms of the narrowest and widest signature.
NARROW, WIDE = 8, 20
#: Counts from which a term is entered once more.
LEVELS = (1, 2, 3, 4, 6, 8, 16, 32)
#: Documents of the highest bounds that are scored first, for each result wanted.
FIRST = 2
#: Query terms of asked pairs that are looked up at once.
LOOKUPS = 1 << 18
#: Terms of one block of queries.
BLOCK_TERMS = 200_000

# Bytes that part terms; all non-ASCII bytes belong to terms.
SEPARATORS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])

_LEVEL = np.random.default_rng(11).integers(1, 2**63, len(LEVELS), dtype=np.uint64)


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each row with repeats, row, hash and count of its distinct terms);
    rows ascend, and hashes inside a row."""
    starts, ends, at = word_spans(data, offsets, SEPARATORS)
    hashes = span_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    if not len(hashes):
        return np.diff(at), row, hashes, np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])))
    return np.diff(at), row[first], hashes[first], np.diff(np.append(first, len(hashes)))


def _probes(entries: np.ndarray, width: int) -> np.ndarray:
    """Signature bits [entries, PROBES] of entry hashes."""
    step = (entries >> np.uint64(32)) | np.uint64(1)
    return ((entries[..., None] + step[..., None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)


def _entries(hashes: np.ndarray, level: int) -> np.ndarray:
    return mix64(hashes ^ _LEVEL[level])


def slices_of(entries: list[np.ndarray], width: int) -> np.ndarray:
    """The block's slices: bit r of word b is set if document r has signature bit b."""
    held = np.zeros((1 << width, ROWS), bool)
    for r, e in enumerate(entries):
        held[_probes(e, width).ravel(), r] = True
    return np.packbits(held, axis=1, bitorder="little").view(np.uint64).ravel()


def index_documents(docs: DataFrame) -> DataFrame:
    """The staged index: (width, ids, tkeys, sizes, slices), a row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(width: int) -> pa.RecordBatch:
            ids, keys, sizes, entries = zip(*held.pop(width))
            return pa.record_batch([pa.array([width], pa.int32()), pa.array([list(ids)], pa.list_(id_type[0])),
                                    pa.array([list(keys)], pa.list_(pa.int64())), pa.array([list(sizes)], pa.list_(pa.int64())),
                                    pa.array([slices_of(entries, width).tobytes()], pa.binary())], names=names)

        id_type = [pa.int64()]
        for b in batches:
            id_type[0] = b.column(0).type
            for lo, hi, data, offsets in text_slices(b.column(1)):
                n, row, hashes, tf = term_counts(data, offsets)
                each = [(row[tf >= least], _entries(hashes[tf >= least], lv)) for lv, least in enumerate(LEVELS)]
                rows, entries = np.concatenate([r for r, _ in each]), np.concatenate([e for _, e in each])
                order = np.argsort(rows, kind="stable")
                entries, at = entries[order], np.searchsorted(rows[order], np.arange(hi - lo + 1))
                ids, keys = b.column(0).slice(lo, hi - lo).to_pylist(), b.column(2).slice(lo, hi - lo).to_pylist()
                for k in np.flatnonzero(n).tolist():
                    own = entries[at[k]:at[k + 1]].copy()
                    width = min(max(math.ceil(math.log2(len(own) * BITS)), NARROW), WIDE)
                    held.setdefault(width, []).append((ids[k], keys[k], int(n[k]), own))
                    if len(held[width]) == ROWS:
                        yield block(width)
        for width in list(held):
            yield block(width)

    names = ["width", "ids", "tkeys", "sizes", "slices"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("doc_id is not null").select("doc_id", "text", text_key("text").alias("tkey"))
    return stage(rows.mapInArrow(run, f"width int, ids array<{kind}>, tkeys array<long>, sizes array<long>, slices binary"), "signatures")


class Queries:
    """A block of queries: distinct terms in order of hash, and for query q the
    places of its terms, ``terms[starts[q]:starts[q + 1]]``."""

    def __init__(self, ids: list, hashes: list[list[int]]):
        self.ids = ids
        all_terms = [np.array(h, np.int64).view(np.uint64) for h in hashes]
        self.distinct = np.unique(np.concatenate(all_terms))
        self.terms = np.concatenate([np.searchsorted(self.distinct, t) for t in all_terms])
        self.starts = np.append(0, np.cumsum([len(t) for t in all_terms]))

    def weigh(self, n_docs: int, n_terms: int, df: np.ndarray) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)

    def length_norm(self, sizes: np.ndarray) -> np.ndarray:
        return 50 + (50 * sizes * self.n_docs) // self.n_terms

    def places(self, row: np.ndarray, hashes: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of (row, hash, count), those of query terms as (row, term, count)."""
        at = np.minimum(np.searchsorted(self.distinct, hashes), len(self.distinct) - 1)
        mine = self.distinct[at] == hashes
        return row[mine], at[mine], tf[mine]

    def bounds(self, width: int, sizes: np.ndarray, slices: np.ndarray) -> np.ndarray:
        """Upper bounds [queries, documents] of a block's scores."""
        m = self.length_norm(sizes).astype(float)
        present = np.full(len(self.distinct), ~np.uint64(0))
        out = np.zeros((len(self.ids), len(sizes)))
        before = np.zeros(len(sizes))
        for level in range(len(LEVELS)):
            some = np.flatnonzero(present)
            if not len(some):
                break
            bits = _probes(_entries(self.distinct[some], level), width)
            present[some] &= np.bitwise_and.reduce(slices[bits], axis=1)
            most = np.minimum(sizes, LEVELS[level + 1] - 1 if level + 1 < len(LEVELS) else np.iinfo(np.int64).max).astype(float)
            share = 1e9 * most / (1000 * most + 20 * m)
            use = np.flatnonzero(present[self.terms])
            if len(use):
                term = self.terms[use]
                docs = np.unpackbits(present[term].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :len(sizes)]
                query = np.searchsorted(self.starts, use, "right") - 1
                first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
                out[query[first]] += np.add.reduceat(docs * self.weights[term].astype(float)[:, None], first) * (share - before)
            before = share
        return out * (1 + 1e-9) + (out > 0)

    def scores(self, sizes: np.ndarray, row: np.ndarray, hashes: np.ndarray, tf: np.ndarray, doc: np.ndarray, query: np.ndarray
               ) -> np.ndarray:
        """Exact scores of pairs (doc, query) over the counts of ``term_counts``."""
        row, term, tf = self.places(row, hashes, tf)
        key = row * len(self.distinct) + term  # ascending
        value = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * self.length_norm(sizes)[row]))
        key, value = np.append(key, -1), np.append(value, 0)
        count = np.diff(self.starts)[query]
        upto, out = np.append(0, np.cumsum(count)), np.zeros(len(query), np.int64)
        lo = 0
        while lo < len(query):  # so many pairs at once that their terms stay few
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + LOOKUPS, "right")) - 1)
            pair = np.repeat(np.arange(lo, hi), count[lo:hi])
            asked = doc[pair] * len(self.distinct) + self.terms[self.starts[query[pair]] + np.arange(len(pair)) - (upto[pair] - upto[lo])]
            at = np.minimum(np.searchsorted(key[:-1], asked), len(key) - 1)
            out[lo:hi] = np.add.reduceat(np.where(key[at] == asked, value[at], 0), upto[lo:hi] - upto[lo])
            lo = hi
        return out


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): distinct term hashes of every item that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in text_slices(b.column(1)):
                _, row, hashes, _ = term_counts(data, offsets)
                yield pa.record_batch([b.column(0).slice(lo, hi - lo).take(pa.array(row)), pa.array(hashes.view(np.int64))],
                                      names=["item_id", "term"])

    kind = items.schema["item_id"].dataType.simpleString()
    rows = items.where("item_id is not null and text is not null").select("item_id", "text").mapInArrow(run, f"item_id {kind}, term long")
    return rows.groupBy("item_id").agg(F.collect_set("term").alias("terms"))


def query_blocks(items: DataFrame, most: int = BLOCK_TERMS) -> Iterator[Queries]:
    """The queries in blocks of at most ``most`` terms (one query at least)."""
    ids, terms, size = [], [], 0
    for r in stage(query_terms(items), "query-terms").toLocalIterator():
        if ids and size + len(r["terms"]) > most:
            yield Queries(ids, terms)
            ids, terms, size = [], [], 0
        ids.append(r["item_id"])
        terms.append(r["terms"])
        size += len(r["terms"])
    if ids:
        yield Queries(ids, terms)


def corpus_statistics(docs: DataFrame, queries: Queries) -> tuple[int, int, np.ndarray]:
    """(documents with terms, their terms with repeats, documents that hold each
    query term), over all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        total = np.zeros(len(q.distinct) + 2, np.int64)
        for b in batches:
            for _, _, data, offsets in text_slices(b.column(0)):
                n, row, hashes, tf = term_counts(data, offsets)
                total[-2] += (n > 0).sum()
                total[-1] += n.sum()
                total[:-2] += np.bincount(q.places(row, hashes, tf)[1], minlength=len(q.distinct))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["place", "n"])

    rows = docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(len(queries.distinct) + 2, np.int64)
    for r in rows:
        total[r["place"]] = r["n"]
    return int(total[-2]), int(total[-1]), total[:-2]


def _bounds_of(batch: pa.RecordBatch, queries: Queries) -> Iterator[tuple[list, list, np.ndarray]]:
    """(doc ids, text keys, bounds) of each block of an index batch."""
    width, ids, keys, sizes, slices = (batch.column(k) for k in range(5))
    for k in range(batch.num_rows):
        words = np.frombuffer(slices[k].as_buffer(), np.uint64)
        yield ids[k].as_py(), keys[k].as_py(), queries.bounds(width[k].as_py(), np.array(sizes[k].as_py(), np.int64), words)


def _best(value: np.ndarray, query: np.ndarray, k: int, tie: np.ndarray | None = None) -> np.ndarray:
    """Places of the k highest values of each query (ties: smallest ``tie``)."""
    order = np.lexsort((-value, query)) if tie is None else np.lexsort((tie, -value, query))
    sorted_query = query[order]
    rank = np.arange(len(order)) - np.searchsorted(sorted_query, sorted_query)
    return order[rank < k]


def _highest_bounds(index: DataFrame, queries: Queries, k: int) -> DataFrame:
    """(doc_id, tkey, queries): the documents of the k highest bounds of each query."""
    sent = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for b in batches:
            ids, keys, doc, query, bound = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            floor = np.zeros(len(q.ids))
            for some_ids, some_keys, bounds in _bounds_of(b, q):
                r, c = np.nonzero(bounds > floor[:, None])
                query, doc, bound = [*query, r], [*doc, c + len(ids)], [*bound, bounds[r, c]]
                ids, keys = ids + some_ids, keys + some_keys
                if sum(map(len, query)) > 8 * k * len(q.ids):
                    every = [np.concatenate(x) for x in (query, doc, bound)]
                    best = _best(every[2], every[0], k)
                    query, doc, bound = ([x[best]] for x in every)
                    full = np.bincount(query[0], minlength=len(q.ids)) == k
                    least = np.full(len(q.ids), np.inf)
                    np.minimum.at(least, query[0], bound[0])
                    floor = np.where(full, least, 0)
            query, doc, bound = (np.concatenate(x) for x in (query, doc, bound))
            best = _best(bound, query, k)
            yield pa.record_batch([pa.array(ids, b.column(1).type.value_type).take(pa.array(doc[best])), pa.array(keys, pa.int64()).take(pa.array(doc[best])),
                                   pa.array(query[best], pa.int32()), pa.array(bound[best])], names=["doc_id", "tkey", "query", "bound"])

    kind = index.schema["ids"].dataType.elementType.simpleString()
    found = index.mapInArrow(run, f"doc_id {kind}, tkey long, query int, bound double")
    order = Window.partitionBy("query").orderBy(F.col("bound").desc(), "doc_id", "tkey")
    best = found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    return best.groupBy("doc_id", "tkey").agg(F.collect_set("query").alias("queries"))


def _not_excluded(index: DataFrame, queries: Queries, reached: np.ndarray) -> DataFrame:
    """(doc_id, tkey, queries): every document whose bound reaches what a query's
    results reach."""
    sent = index.sparkSession.sparkContext.broadcast((queries, reached))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, least = sent.value
        for b in batches:
            for ids, keys, bounds in _bounds_of(b, q):
                open_pairs = (bounds >= least[:, None]) & (bounds > 0)
                doc, query = np.nonzero(open_pairs.T)
                some = np.flatnonzero(open_pairs.any(0))
                lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(doc, some), len(doc)).astype(np.int32)),
                                                 pa.array(query, pa.int32()))
                yield pa.record_batch([pa.array(ids, b.column(1).type.value_type).take(pa.array(some)),
                                       pa.array(keys, pa.int64()).take(pa.array(some)), lists], names=["doc_id", "tkey", "queries"])

    kind = index.schema["ids"].dataType.elementType.simpleString()
    found = index.mapInArrow(run, f"doc_id {kind}, tkey long, queries array<int>")
    return found.dropDuplicates(["doc_id", "tkey"])  # repeated rows have equal signatures and bounds


def _exact(docs: DataFrame, asked: DataFrame, queries: Queries, k: int, reached: np.ndarray | None) -> DataFrame:
    """(query, doc_id, score) above 0 of the asked pairs, at most the k best of a
    query from each batch of texts; with ``reached`` only scores that reach it."""
    sent = docs.sparkSession.sparkContext.broadcast((queries, reached))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, least = sent.value
        for b in batches:
            parts = [[np.zeros(0, np.int64)] * 3]
            for lo, hi, data, offsets in text_slices(b.column(1)):
                n, row, hashes, tf = term_counts(data, offsets)
                lists = b.column(2).slice(lo, hi - lo)
                query = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy(zero_copy_only=False))
                score = q.scores(n, row, hashes, tf, doc, query)
                good = np.flatnonzero((score > 0) & (score >= (least[query] if least is not None else 0)))
                parts.append([query[good], doc[good] + lo, score[good]])
            query, doc, score = (np.concatenate(x) for x in zip(*parts))
            names = b.column(0).take(pa.array(doc))
            tie = np.argsort(np.argsort(names.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
            best = _best(score, query, k, tie)
            yield pa.record_batch([pa.array(query[best], pa.int32()), names.take(pa.array(best)), pa.array(score[best])],
                                  names=["query", "doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", text_key("text").alias("tkey"))
    met = null_safe(rows, light_side(asked, 24 + 4 * F.size("queries")), ["doc_id", "tkey"])
    return met.select("doc_id", "text", "queries").mapInArrow(run, f"query int, doc_id {kind}, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k highest-scoring documents."""
    spark = docs.sparkSession
    kinds = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()
    index, found = None, None
    for queries in query_blocks(items):
        n_docs, n_terms, df = corpus_statistics(docs, queries)
        if not n_docs:
            break
        queries.weigh(n_docs, n_terms, df)
        index = index_documents(docs) if index is None else index
        first = stage(_exact(docs, stage(_highest_bounds(index, queries, FIRST * k), "search-first"), queries, k, None), "search-scores")
        kth = (first.withColumn("_rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc())))
               .where(F.col("_rank") == k).select("query", "score").collect())
        reached = np.zeros(len(queries.ids))
        for r in kth:
            reached[r["query"]] = r["score"]
        scored = _exact(docs, stage(_not_excluded(index, queries, reached), "search-open"), queries, k, reached)
        names = spark.createDataFrame(list(enumerate(queries.ids)), f"query int, item_id {kinds[0]}")
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), "doc_id")
        best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        block = stage(best.join(names, "query").select("item_id", "rank", "doc_id", "score"), "search-ranked")
        found = block if found is None else found.unionByName(block)
    return found if found is not None else spark.createDataFrame([], f"item_id {kinds[0]}, rank int, doc_id {kinds[1]}, score long")


def op11_lexical_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Contract: the 50 best documents of every benchmark item."""
    return ranked(docs, items, 50)


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL
), tf AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY rid, term
), stats AS (
  SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, stats GROUP BY term, n_docs
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL
), m AS (
  SELECT rid, doc_id, 50 + (50 * len(w) * n_docs) // n_terms AS m FROM d, stats WHERE len(w) > 0 AND doc_id IS NOT NULL
), s AS (
  SELECT q.item_id, m.rid, m.doc_id, CAST(sum(weight.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * m.m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN weight USING (term) JOIN m USING (rid) GROUP BY q.item_id, m.rid, m.doc_id
), r AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
