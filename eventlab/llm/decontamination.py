"""Benchmark decontamination by a prefix-filtered set join, in DataFrame
expressions only.

A benchmark item is cut into windows of ``window`` consecutive words (an item of
fewer words is one window). A document is contaminated where a window occurs in
it, word for word.

1. A window's set holds its shingles of ``SHINGLE`` words (fewer for shorter
   windows). Documents meet the shingles of all windows by hash; the hits count
   how often each shingle occurs in the whole corpus, which orders shingles by
   rarity.
2. A document that holds a window holds all its shingles, so the necessary prefix
   of a window is its rarest shingle. Only hits of prefix shingles make
   candidates, one for each place, and none is left if the shingle occurs nowhere.
3. The place and the shingle's offset fix where the window must begin; candidates
   that begin before the text or end after it go (positional and length bound).
4. A candidate is verified on the words themselves over the window's length.

Words are hashed in lower case, which only makes candidates; the exact comparison
folds A-Z alone. Equal windows of several items are one window until the items of
a document are listed.

Defined cases: null and empty texts have no words and are clean; items without an
id or without words take no part; repeated items count once; rows that repeat a
doc_id are judged by their own text; a null doc_id is kept as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlab.llm.common import light_side, null_safe, small_side, text_key
from eventlab.sources.files import stage

# What separates the words of the contract; A-Z are lowered afterwards.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WINDOW = 10
SHINGLE = 5


def _words(text: str) -> Column:
    """Words as written; a null text has none."""
    return F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), GAP), "")


def _folded(words: Column, start: Column, length: Column) -> Column:
    """``length`` words from place ``start`` (0 is the first), A-Z lowered, with single spaces."""
    return F.translate(F.array_join(F.slice(words, start + 1, length), " "), UPPER, LOWER)


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _shingle(hashes: str, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *[F.get(F.col(hashes), at + k) for k in range(width)])


def benchmark_windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """((wid, phrase, len) of the distinct windows, (wid, item_id))."""
    rows = items.where("item_id is not null").select(
        F.col("item_id").cast("string").alias("item_id"), _words("text").alias("words"))
    rows = rows.withColumn("len", F.least(F.size("words"), F.lit(window))).where("len > 0")
    rows = rows.select("item_id", "words", "len", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("len"))).alias("at"))
    rows = rows.select("item_id", "len", _folded(F.col("words"), F.col("at"), F.col("len")).alias("phrase"))
    held = stage(rows.select(F.sha2("phrase", 256).alias("wid"), "item_id", "phrase", "len").distinct(), "window-items")
    return held.groupBy("wid").agg(F.first("phrase").alias("phrase"), F.first("len").alias("len")), held.select("wid", "item_id")


def window_shingles(windows: DataFrame) -> DataFrame:
    """(wid, phrase, len, width, offset, key): the shingles of every window."""
    rows = windows.withColumn("width", F.least("len", F.lit(SHINGLE)))
    rows = rows.withColumn("h", _hashes(F.split("phrase", " ")))
    rows = rows.withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("width"))))
    key = reduce(lambda other, w: F.when(F.col("width") == w, _shingle("h", F.col("offset"), w)).otherwise(other),
                 range(1, SHINGLE), _shingle("h", F.col("offset"), SHINGLE))
    return rows.select("wid", "phrase", "len", "width", "offset", key.alias("key"))


def shingle_hits(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """(doc_id, tkey, n, at, key): every place of a document that holds a shingle
    of the benchmark. One scan for each shingle width in use, one if no window is
    shorter than a shingle."""
    rows = docs.select("doc_id", text_key("text").alias("tkey"), _words("text").alias("words"))
    rows = rows.select("doc_id", "tkey", F.size("words").alias("n"), _hashes(F.col("words")).alias("h"))
    parts = []
    for (width,) in sorted(shingles.select("width").distinct().collect()):
        at = F.explode(F.sequence(F.lit(0), F.col("n") - width)).alias("at")
        places = rows.where(F.col("n") >= width).select("doc_id", "tkey", "n", "h", at)
        places = places.select("doc_id", "tkey", "n", "at", _shingle("h", F.col("at"), width).alias("key"))
        parts.append(places.join(small_side(shingles.where(F.col("width") == width).select("key").distinct()), "key", "left_semi"))
    return reduce(DataFrame.unionByName, parts) if parts else rows.where("false").select(
        "doc_id", "tkey", "n", F.lit(0).alias("at"), F.lit(0).cast("long").alias("key"))


def candidate_windows(hits: DataFrame, shingles: DataFrame) -> DataFrame:
    """(doc_id, tkey, candidates): per document, where which windows may begin."""
    often = hits.groupBy("key").agg(F.count(F.lit(1)).alias("often"))
    rare = shingles.join(often, "key", "left").fillna(0, ["often"])
    prefix = rare.groupBy("wid").agg(F.min(F.struct("often", "key", "offset", "phrase", "len")).alias("p"))
    prefix = stage(prefix.where("p.often > 0").select("wid", "p.key", "p.offset", "p.phrase", "p.len"), "window-prefixes")
    begin = F.col("at") - F.col("offset")
    found = hits.join(light_side(prefix, F.octet_length("phrase") + 100), "key").where((begin >= 0) & (begin + F.col("len") <= F.col("n")))
    return found.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct(
        begin.alias("begin"), F.col("len"), F.col("wid"), F.col("phrase"))).alias("candidates"))


def _covered(places: Column) -> Column:
    """Number of words inside at least one of the places (begin, len)."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("words"))
    end = lambda p: p["begin"] + p["len"]
    step = lambda a, p: F.struct(F.greatest(a["upto"], end(p)).alias("upto"), (
        a["words"] + F.greatest(F.lit(0), end(p) - F.greatest(a["upto"], p["begin"]))).alias("words"))
    return F.aggregate(F.array_sort(places), start, step, lambda a: a["words"])


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, item_ids (sorted as strings) of every document."""
    windows, holders = benchmark_windows(items, window)
    shingles = stage(window_shingles(windows), "window-shingles")
    hits = stage(shingle_hits(docs, shingles), "shingle-hits")
    asked = stage(candidate_windows(hits, shingles), "window-candidates")

    rows = docs.select("doc_id", "text", text_key("text").alias("tkey"))
    cost = F.aggregate("candidates", F.lit(100), lambda total, c: total + F.octet_length(c["phrase"]) + 100)
    met = null_safe(rows, light_side(asked, cost), ["doc_id", "tkey"], "left").withColumn("words", _words("text"))
    true = F.filter("candidates", lambda c: _folded(F.col("words"), c["begin"], c["len"]) == c["phrase"])
    met = met.select("doc_id", "tkey", F.size("words").cast("long").alias("n_words"), F.coalesce(true, F.array().cast(
        asked.schema["candidates"].dataType)).alias("found"))
    places = F.transform("found", lambda c: F.struct(c["begin"].alias("begin"), c["len"].alias("len")))
    met = stage(met.select("doc_id", "tkey", "n_words", _covered(places).cast("long").alias("n_hit"),
                           F.array_distinct(F.transform("found", lambda c: c["wid"])).alias("wids")), "window-found")
    listed = (met.where("n_hit > 0").select("doc_id", "tkey", F.explode("wids").alias("wid")).distinct()
              .join(light_side(holders, 100), "wid").groupBy("doc_id", "tkey")
              .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")))
    held = null_safe(met.where("n_hit > 0"), listed, ["doc_id", "tkey"])
    none = met.where("n_hit = 0").withColumn("item_ids", F.array().cast("array<string>"))
    both = held.unionByName(none)
    return both.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids")


def op13_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Contract columns; the items' ids as a digest."""
    return contaminated(docs, items).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


OP13_SQL = rf"""
WITH bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[i:i + 9], ' ') AS phrase
  FROM bw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
), dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), places AS (
  SELECT rid, i AS s, l, array_to_string(w[i:i + l - 1], ' ') AS phrase
  FROM dw, (SELECT DISTINCT l FROM win) AS ls, unnest(range(1, len(w) - l + 2)) AS u(i)
), found AS (
  SELECT p.rid, p.s, p.l, p.phrase FROM places p SEMI JOIN win USING (phrase)
), hit AS (
  SELECT rid, count(DISTINCT s + k) AS n_hit FROM found, unnest(range(0, l)) AS u(k) GROUP BY rid
), held AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT f.rid, win.item_id FROM found f JOIN win USING (phrase)) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (rid) LEFT JOIN held USING (rid)
"""
