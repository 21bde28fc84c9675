"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame
expressions only.

Each source has a target number of words. Its documents share one copy rate
``target / source_size``; the whole part is taken outright and the fraction is
rounded by the pivotal method: two documents exchange expected words until one
of them is in or out, so the expected words of the pair never change. Chunks of
documents are folded that way, each leaving at most one undecided document;
those meet again in larger chunks (a reduction tree) until one per source is
left, which is decided by a coin. A source's words therefore differ from its
target by less than its last undecided document.

Defined cases: a null text has size 0 and copies by the whole part of the rate;
documents of size 0 are never rounded up. Null sources form the last source.
Equal rows (same id, source and text) are one unit and share one decision. A
source of size 0 has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlab.llm.common import WORD, null_safe, small_side, text_key
from eventlab.sources.files import stage

#: Documents folded by one group of the reduction tree.
FAN_IN = 64
#: Above this many sources the table of rates is joined by a shuffle.
MAX_BROADCAST_SOURCES = 10_000
#: No document is taken more often than this.
MAX_COPIES = 3


def source_targets(totals: DataFrame) -> DataFrame:
    """Targets per source from (source, source_size): weights 1, 2, 3, repeating
    in code point order (null last) share all words; no target exceeds
    ``MAX_COPIES`` times its source, the excess goes to the others by weight.

    The shares that stop at their cap are those with the smallest cap per
    weight, so one ordered pass over the sources finds them.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    t = totals.withColumn("weight", ((F.row_number().over(everything) - 1) % 3 + 1).cast("double"))
    t = t.withColumn("cap", F.lit(float(MAX_COPIES)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    t = (t.withColumn("left_words", F.sum("source_size").over(whole)
                      - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("share", F.col("left_words") / F.sum("weight").over(rest))
         .withColumn("capped", F.col("share") * F.col("weight") > F.col("cap"))
         .withColumn("level", F.max(F.when(~F.col("capped"), F.col("share"))).over(whole)))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return t.select("source", "source_size", target.alias("target"))


def _is_decided(p: Column) -> Column:
    return (p <= 0.0) | (p >= 1.0)


def _coin(*cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def _with_p(unit: Column, p: Column) -> Column:
    return F.struct(unit["words"].alias("words"), unit["mark"].alias("mark"), unit["doc_id"].alias("doc_id"),
                    unit["tkey"].alias("tkey"), p.alias("p"))


def _fold(units: Column, seed: int) -> Column:
    """Pivotal rounding of an array of (words, mark, doc_id, tkey, p). Long
    documents come first, so that the one left over is likely short."""

    def step(acc: Column, unit: Column) -> Column:
        cur = acc["cur"]
        a, p, b, q = cur["words"], cur["p"], unit["words"], unit["p"]
        up_room, up_give = a * (1.0 - p), b * q
        down_room, down_give = a * p, b * (1.0 - q)
        up = F.least(up_room, up_give)
        down = F.least(down_room, down_give)
        goes_up = _coin(cur["mark"], unit["mark"], F.lit(seed)) * (up + down) < down
        cur_ends = F.when(goes_up, up_room <= up_give).otherwise(down_room <= down_give)
        # the one that ends gets 0 or 1 exactly, the other keeps the rest of the pair's words
        cur_p = F.when(cur_ends, F.when(goes_up, 1.0).otherwise(0.0)).otherwise(
            F.when(goes_up, p + up_give / a).otherwise(p - down_give / a))
        unit_p = F.when(~cur_ends, F.when(goes_up, 0.0).otherwise(1.0)).otherwise(
            F.when(goes_up, q - up_room / b).otherwise(q + down_room / b))
        ended = F.when(cur_ends, _with_p(cur, cur_p)).otherwise(_with_p(unit, unit_p))
        goes_on = F.when(cur_ends, _with_p(unit, unit_p)).otherwise(_with_p(cur, cur_p))
        fresh = cur.isNull() | _is_decided(p)
        return F.struct(
            F.when(cur.isNull(), acc["done"]).when(_is_decided(p), F.concat(acc["done"], F.array(cur)))
            .otherwise(F.concat(acc["done"], F.array(ended))).alias("done"),
            F.when(fresh, _with_p(unit, q)).otherwise(goes_on).alias("cur"))

    unit_type = "struct<words:double,mark:bigint,doc_id:string,tkey:bigint,p:double>"
    start = F.struct(F.array().cast(f"array<{unit_type}>").alias("done"),
                     F.lit(None).cast(unit_type).alias("cur"))
    return F.aggregate(units, start, step)


def pivotal_round(units: DataFrame, seed: int = 8, fan_in: int = FAN_IN) -> DataFrame:
    """Decide ``p`` of units (source, doc_id, tkey, words > 0, 0 < p < 1) to 0 or
    1 so that each source's expected words stay. Returns the units with ``x``.

    Level by level, chunks of about ``fan_in`` units are folded and written;
    the undecided unit of each chunk goes to the next level.
    """
    mark = F.xxhash64(F.lit(seed), "doc_id", "tkey")
    sizes = units.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    chunks = F.ceil(F.col("n") / fan_in).cast("long")
    most = sizes.agg(F.max(chunks)).first()[0]
    level = null_safe(units, small_side(sizes, MAX_BROADCAST_SOURCES), ["source"]).select(
        "source", F.pmod(mark, chunks).alias("chunk"),
        F.struct(F.col("words").cast("double").alias("words"), mark.alias("mark"),
                 F.col("doc_id").cast("string").alias("doc_id"), "tkey", "p").alias("unit"))
    decided = None
    while most is not None:
        folded = (level.groupBy("source", "chunk").agg(F.sort_array(F.collect_list("unit"), asc=False).alias("units"))
                  .select("source", "chunk", _fold(F.col("units"), seed).alias("f")))
        folded = stage(folded, "mixing-level")
        last = most <= 1
        done = folded.select("source", F.explode("f.done").alias("u"))
        cur = folded.select("source", "chunk", F.col("f.cur").alias("u"))
        if last:
            p = F.when(_is_decided(F.col("u.p")), F.col("u.p")).otherwise(
                F.when(_coin(F.col("u.mark"), F.lit(seed + 1)) < F.col("u.p"), 1.0).otherwise(0.0))
            ends = cur.select("source", _with_p(F.col("u"), p).alias("u"))
        else:
            ends = cur.where(_is_decided(F.col("u.p"))).select("source", "u")
        done = done.unionByName(ends)
        decided = done if decided is None else decided.unionByName(done)
        if last:
            break
        level = cur.where(~_is_decided(F.col("u.p"))).select(
            "source", F.floor(F.col("chunk") / fan_in).alias("chunk"), F.col("u").alias("unit"))
        most = -(-most // fan_in)
    if decided is None:
        return units.select("source", "doc_id", "tkey", F.lit(0).alias("x"))
    return decided.select("source", F.col("u.doc_id").cast(units.schema["doc_id"].dataType).alias("doc_id"),
                          F.col("u.tkey").alias("tkey"), F.col("u.p").cast("int").alias("x"))


def mix_sources(docs: DataFrame, seed: int = 8, fan_in: int = FAN_IN) -> DataFrame:
    """One row per distinct (doc_id, source, text): ``reps`` equal rows, their
    size, the source's size and target, and the copies of each such row."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", text_key("text").alias("tkey"), size.alias("size"))
    slim = stage(rows.groupBy("doc_id", "source", "tkey", "size").agg(F.count(F.lit(1)).alias("reps")),
                 "mixing-sizes")
    totals = slim.groupBy("source").agg(F.sum(F.col("size") * F.col("reps")).alias("source_size"))
    targets = stage(source_targets(totals), "mixing-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.least(F.floor("rate"), F.lit(MAX_COPIES)).cast("long")
    rated = (null_safe(slim, small_side(targets, MAX_BROADCAST_SOURCES), ["source"])
             .withColumn("rate", rate).withColumn("base", base)
             .withColumn("p", F.when(F.col("base") >= MAX_COPIES, 0.0).otherwise(F.col("rate") - F.col("base"))))
    rounded = (F.col("size") > 0) & (F.col("p") > 0.0)
    units = rated.where(rounded).select("source", "doc_id", "tkey",
                                        (F.col("size") * F.col("reps")).alias("words"), "p")
    decided = pivotal_round(units, seed, fan_in)
    joined = null_safe(rated, decided, ["source", "doc_id", "tkey"], "left")
    copies = F.col("base") + F.coalesce(F.col("x"), F.lit(0))
    return joined.select("doc_id", "source", "tkey", "reps", "size", "source_size", "target",
                         copies.cast("int").alias("copies"))


def op8_source_mixing(docs: DataFrame) -> DataFrame:
    """Contract columns, one row per input row."""
    mixed = mix_sources(docs)
    return (mixed.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.col("reps").cast("int"))))
            .select("doc_id", "size", "source_size", "target",
                    (F.col("size") * F.col("copies")).alias("taken"), "copies"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, columns as given."""
    keyed = docs.withColumn("_mix_tkey", text_key("text"))
    copies = mix_sources(docs).where(F.col("copies") > 0).select(
        "doc_id", "source", F.col("tkey").alias("_mix_tkey"), F.col("copies").alias("_mix_copies"))
    joined = null_safe(keyed, copies, ["doc_id", "source", "_mix_tkey"])
    return joined.withColumn("_mix_turn", F.explode(F.sequence(F.lit(1), "_mix_copies"))).select(*docs.columns)
