"""Sources and sinks: parquet tables, delimited text with declared schemas,
malformed-row quarantine and stage tables.

Schemas are always declared (ids such as ``1001`` and ``SPL1052`` share a
column, so inference would be wrong). Timestamp columns are read as text and
parsed with several formats; ``NA`` is a NULL token.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampNTZType, TimestampType

from eventlab.functions.columns import TIMESTAMP_FORMATS, parse_timestamp
from eventlab.session import stage_path

CORRUPT = "_corrupt_record"
# The lines a merge conflict leaves in a committed file.
MERGE_MARKER = r"^(<{7}|={7}|>{7})"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (parquet); column pruning and filters reach the scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _text_schema(schema: StructType) -> tuple[StructType, list[str]]:
    ts_cols = [f.name for f in schema.fields
               if isinstance(f.dataType, (TimestampType, TimestampNTZType))]
    fields = [StructField(f.name, StringType(), True) if f.name in ts_cols else f
              for f in schema.fields]
    return StructType(fields), ts_cols


def read_delimited(spark: SparkSession, path: str, schema: StructType, sep: str = ",",
                   na_tokens: str = "NA", timestamp_formats: Sequence[str] = TIMESTAMP_FORMATS
                   ) -> DataFrame:
    """A1: delimited text with a header row, declared schema and NA tokens."""
    text_schema, ts_cols = _text_schema(schema)
    df = (spark.read.schema(text_schema)
          .option("header", True).option("sep", sep).option("nullValue", na_tokens)
          .option("mode", "PERMISSIVE").csv(path))
    return df.withColumns({c: parse_timestamp(c, timestamp_formats) for c in ts_cols})


def read_quarantined(spark: SparkSession, path: str, schema: StructType, sep: str = ",",
                     na_tokens: str = "NA", timestamp_formats: Sequence[str] = TIMESTAMP_FORMATS
                     ) -> tuple[DataFrame, DataFrame]:
    """A4: split rows that fail the declared schema (wrong field count or type,
    merge markers, repeated header lines, unparseable timestamps) from good
    rows. Returns (good, bad); ``bad`` keeps the raw line."""
    text_schema, ts_cols = _text_schema(schema)
    with_corrupt = StructType(text_schema.fields + [StructField(CORRUPT, StringType(), True)])
    raw = (spark.read.schema(with_corrupt)
           .option("header", True).option("sep", sep).option("nullValue", na_tokens)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
           .csv(path))
    first = schema.fields[0].name
    parsed = raw.withColumns({f"_raw_{c}": F.col(c) for c in ts_cols})
    parsed = parsed.withColumns({c: parse_timestamp(f"_raw_{c}", timestamp_formats) for c in ts_cols})
    bad_flag = (F.col(CORRUPT).isNotNull()
                | F.coalesce(F.col(first).cast("string").rlike(MERGE_MARKER), F.lit(False))
                | F.coalesce(F.col(first).cast("string") == F.lit(first), F.lit(False)))
    for c in ts_cols:
        bad_flag = bad_flag | (F.col(c).isNull() & F.col(f"_raw_{c}").isNotNull())
    parsed = parsed.withColumn("_bad", bad_flag)
    good = parsed.where(~F.col("_bad")).select(*schema.names)
    bad = parsed.where(F.col("_bad")).select(F.coalesce(F.col(CORRUPT), F.concat_ws(
        sep, *[F.coalesce(F.col(f"_raw_{c}") if c in ts_cols else F.col(c).cast("string"),
                          F.lit(na_tokens)) for c in schema.names])).alias("raw_line"))
    return good, bad


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): the lines of delimited text files, numbered from 1 in
    each file. Lines are numbered inside the file's blocks as they are read; the
    blocks before give the offset, from a table with one row for each block."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    raw = stage(raw, "lines")
    blocks = raw.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return raw.join(blocks, ["file", "_block"]).select(
        "file", (F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "line")


#: Why a line is quarantined, in the order in which the reasons are tried.
REASONS = ("merge marker", "repeated header", "blank header", "field count", "type")


def read_with_reasons(spark: SparkSession, path: str, schema: StructType, sep: str = ",", na_tokens: str = "NA",
                      timestamp_formats: Sequence[str] = TIMESTAMP_FORMATS) -> tuple[DataFrame, DataFrame]:
    """A1 + A4: delimited text with a header line in every file, as (good, bad).
    ``good`` has the declared columns; ``bad`` is (file, line_no, reason, field, line)
    with the first reason of ``REASONS`` that holds and, for "type", the first field
    whose text is neither empty, an NA token nor a value of its type. The header
    itself is bad where a cell is blank, or else it is no row. Quoted fields may
    hold the separator, not a line break. Empty lines are no rows."""
    text = StructType([StructField(f.name, StringType(), True) for f in schema.fields] + [StructField(CORRUPT, StringType(), True)])
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "nullValue": na_tokens, "emptyValue": ""}
    lines = numbered_lines(spark, path).where(F.length(F.trim("line")) > 0)
    rows = lines.withColumn("_c", F.from_csv("line", _ddl(text), options))
    cells = {f.name: F.col("_c")[f.name] for f in schema.fields}

    def value(f: StructField):
        raw = F.nullif(cells[f.name], F.lit(""))
        if isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            return parse_timestamp(raw, timestamp_formats).cast(f.dataType)
        return raw if isinstance(f.dataType, StringType) else raw.try_cast(f.dataType)

    values = {f.name: value(f) for f in schema.fields}
    wrong = F.coalesce(*[F.when(F.nullif(cells[n], F.lit("")).isNotNull() & v.isNull(), F.lit(n)) for n, v in values.items()])
    header = F.col("line_no") == 1
    names = sep.join(schema.names)
    same = F.trim("line") == F.lit(names)
    blank = F.exists(F.split("line", F.lit("\\Q" + sep + "\\E")), lambda x: F.trim(F.regexp_replace(x, '"', "")) == "")
    reason = (F.when(F.col("line").rlike(MERGE_MARKER), REASONS[0]).when(~header & same, REASONS[1])
              .when(header & blank, REASONS[2]).when(header, None).when(F.col("_c")[CORRUPT].isNotNull(), REASONS[3])
              .when(wrong.isNotNull(), REASONS[4]))
    judged = rows.select("file", "line_no", "line", reason.alias("reason"), wrong.alias("field"), header.alias("_header"),
                         *[v.alias(n) for n, v in values.items()])
    good = judged.where("reason is null and not _header").select(*schema.names)
    bad = judged.where("reason is not null").select("file", "line_no", "reason", F.when(F.col("reason") == REASONS[4], F.col("field"))
                                                    .alias("field"), "line")
    return good, bad


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: Sequence[str] = (), na_token: str = "NA") -> None:
    """A2: materialise a result table (overwrite). CSV gets a header, ``NA``
    for NULL and microsecond timestamps; parquet may be partitioned."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        (w.option("header", True).option("nullValue", na_token).option("emptyValue", "")
         .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
         .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))
    else:
        w.parquet(path)


def stage(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """A3: hand a table to the next step through parquet in the shared folder
    (cuts lineage; survives executor loss). The schema is known, so reading it
    back needs no file, also where a partitioned table has no rows."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    write_table(df, path, "parquet", partition_by)
    return spark.read.schema(df.schema).parquet(path)
