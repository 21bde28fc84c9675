"""Line de-duplication by a deletion-neighbourhood join, in DataFrame
expressions only.

Lines are compared as sequences of words, whatever white space stands between,
before and after them. A line goes if an earlier line of the corpus, in order of
(doc_id, line number), holds the same words or is within one edit: a word more,
less or replaced. Lines of fewer than ``MIN_WORDS`` words only go as exact
repeats; lines without words stay.

1. Equal lines meet by hash in a partial aggregate that keeps the first place.
2. A line within one edit of another shares its first or its last ``g`` words
   with it, ``g`` at most half its length (a coarse grid of lengths). Lines that
   share neither with a different line need no variants.
3. The others emit every variant with one word deleted, and themselves, as
   hashed keys. Equal keys with the same deleted place are replacements, a
   variant equal to a whole line is an insertion. Instead of the pairs of a key,
   each line takes the earliest line of its keys: whether any earlier line is
   near is all that counts, so a key of n lines makes n links.
4. Each line's link is verified on the words themselves.

Defined cases: a null text has no lines and stays null; repeated rows (same id
and text) hold the same places, so they keep the same lines; equal ids with
different texts are ordered by a hash of the text; null ids come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlab.llm.common import null_safe, small_side, text_key
from eventlab.sources.files import stage

#: Shorter lines are only compared exactly.
MIN_WORDS = 6
#: A character that makes a line more than blank.
INK = r"[^\x20\x09-\x0D]"
GAP = r"[\x20\x09-\x0D]+"
#: White space that doesn't stand singly between words; a line holds no line feed.
UNEVEN = ("  ", "\t", "\x0b", "\x0c", "\r")
#: Words from which a line's variants are made word by word instead of from its text
#: (which takes the square of the words, about 0.1 GB hashed for a line of so many).
LONG = 4096


def _even(line: Column) -> Column:
    """The words of a line with one space between them."""
    uneven = line.startswith(" ") | line.endswith(" ")
    for gap in UNEVEN:
        uneven = uneven | line.contains(gap)
    return F.when(uneven, F.trim(F.regexp_replace(line, GAP, " "))).otherwise(line)


def _n_words(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _first(line: Column, n: Column) -> Column:
    return F.call_function("substring_index", line, F.lit(" "), n)


def _last(line: Column, n: Column) -> Column:
    return F.call_function("substring_index", line, F.lit(" "), -n)


def _grid(n: Column) -> Column:
    """The largest of 2, 3, 4, 6, 8, 12, 16, 24 ... that is at most n / 2."""
    half = (n / 2).cast("int")
    power = F.pow(F.lit(2.0), F.floor(F.log2(half.cast("double") + 0.5))).cast("int")
    return F.when(half * 2 >= power * 3, (power * 3 / 2).cast("int")).otherwise(power)


def _end_keys(line: Column, own: Column, shorter: Column) -> Column:
    """Hashes of the first and last words that a line within one edit may share."""

    def ends(g: Column) -> list[Column]:
        return [F.xxhash64(F.lit("first"), g, _first(line, g)), F.xxhash64(F.lit("last"), g, _last(line, g))]

    return (F.when(own.isNull(), F.array().cast("array<bigint>"))
            .when(own == shorter, F.array(*ends(own))).otherwise(F.array(*ends(own), *ends(shorter))))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, line_no, line, h1, h2) of every line with words; ``line`` has
    one space between them."""
    rows = docs.where(F.col("text").isNotNull()).select(
        "doc_id", text_key("text").alias("tkey"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", _even(F.col("line"))).where("line <> ''")
    return rows.withColumns(
        {"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(2), "line")})


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words differ by at most one word: the words that both
    begin with and those that both end with leave at most one."""
    same = lambda x, y: F.zip_with(x, y, lambda u, v: u.eqNullSafe(v))

    def alike(flags: Column) -> Column:
        """Leading true flags; one array may be a word longer."""
        first = F.array_position(flags, False)
        return F.when(first == 0, F.size(flags)).otherwise(first - 1)

    longer = F.greatest(F.size(a), F.size(b))
    ends = alike(same(a, b)) + alike(same(F.reverse(a), F.reverse(b)))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (ends >= longer - 1)


def _deleted(line: Column, n: Column, i: Column) -> Column:
    """The line without its i-th word."""
    return (F.when(i == 1, _last(line, n - 1)).when(i == n, _first(line, n - 1))
            .otherwise(F.concat(_first(line, i - 1), F.lit(" "), _last(line, n - i))))


def _variants_by_word(found: DataFrame) -> DataFrame:
    """(lid, gone, key) as the text's variants, in time linear in a line's words:
    hashes of (place, word) before the missing word, and after it of the place
    one less, joined by exclusive or. Lines of about ``LONG`` words have keys of both
    kinds, so lines of neighbouring lengths always share a kind."""
    words = found.select("lid", F.posexplode(F.split("line", " ")).alias("at", "word"))
    words = words.withColumns({"here": F.xxhash64("at", "word"), "moved": F.xxhash64(F.col("at") - 1, "word")})
    line = Window.partitionBy("lid")
    upto = line.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.bit_xor("here").over(upto).bitwiseXOR(F.col("here"))
    after = F.bit_xor("moved").over(line).bitwiseXOR(F.bit_xor("moved").over(upto))
    gone = F.struct((F.col("at") + 1).cast("int").alias("gone"), before.bitwiseXOR(after).alias("key"))
    whole = F.struct(F.lit(0).alias("gone"), F.bit_xor("here").over(line).alias("key"))
    keyed = words.select("lid", "at", gone.alias("one"), whole.alias("all"))
    both = F.when(F.col("at") == 0, F.array("all", "one")).otherwise(F.array("one"))
    return keyed.select("lid", F.explode(both).alias("v")).select("lid", "v.gone", "v.key")


def near_lines(lines: DataFrame, first: DataFrame) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier line within one edit."""
    keyed = first.select("h1", F.explode("ends").alias("end"))
    shared = (keyed.groupBy("end").agg(F.min("h1").alias("a"), F.max("h1").alias("b"))
              .where("a <> b").select("end"))
    shared = stage(shared, "line-shared-ends")
    wanted = keyed.join(small_side(shared), "end", "left_semi").select("h1").distinct()
    wanted = stage(wanted, "line-candidates")
    # the place orders lines, and so does the id that a global sort gives them
    found = (lines.join(small_side(wanted), "h1", "left_semi")
             .select("h1", "h2", "line", F.struct("doc_id", "tkey", "line_no").alias("place")))
    found = (found.groupBy("h1", "h2").agg(F.min(F.struct("place", "line")).alias("m"))
             .select("h1", "h2", "m.place", "m.line").sort("place")
             .withColumn("lid", F.monotonically_increasing_id()).withColumn("n", _n_words(F.col("line"))))
    found = stage(found.drop("place"), "line-words")

    # place 0 is the whole line
    keys = F.concat(F.array(F.xxhash64("line")), F.transform(
        F.sequence(F.lit(1), F.col("n")), lambda i: F.xxhash64(_deleted(F.col("line"), F.col("n"), i))))
    short = found.where(F.col("n") <= LONG + 1).select("lid", F.posexplode(keys).alias("gone", "key"))
    variants = stage(short.unionByName(_variants_by_word(found.where(F.col("n") >= LONG))), "line-variants")
    by_place = variants.groupBy("key", "gone").agg(F.min("lid").alias("lead"), F.count(F.lit(1)).alias("members"))
    by_key = stage(by_place.groupBy("key").agg(
        F.min(F.when(F.col("gone") == 0, F.col("lead"))).alias("whole"),
        F.min(F.when(F.col("gone") > 0, F.col("lead"))).alias("shortened"),
        F.sum("members").alias("members"),
        F.map_from_entries(F.collect_list(F.when(F.col("members") > 1, F.struct("gone", "lead")))).alias("leads"))
        .where("members > 1"), "line-keys")
    lead = F.when(F.col("gone") == 0, F.col("shortened")).otherwise(
        F.least(F.col("whole"), F.try_element_at("leads", F.col("gone"))))
    links = (variants.join(by_key, "key").select("lid", lead.alias("lead")).where("lead < lid")
             .groupBy("lid").agg(F.min("lead").alias("lead")))
    words = F.split("line", " ")
    one = found.select("lid", "h1", "h2", words.alias("words"))
    other = found.select(F.col("lid").alias("lead"), words.alias("lead_words"))
    pairs = links.join(one, "lid").join(other, "lead")
    return pairs.where(within_one_edit(F.col("words"), F.col("lead_words"))).select("h1", "h2")


def _cut(docs: DataFrame) -> DataFrame:
    """The documents' columns, and ``_all_lines`` and ``_stays`` (arrays of lines)."""
    lines = _lines(docs.select("doc_id", "text"))
    n = _n_words(F.col("line"))
    sized = lines.withColumns({"own": F.when(n >= MIN_WORDS, _grid(n)), "shorter": F.when(n >= MIN_WORDS, _grid(n - 1))})
    first = (sized.select("h1", "h2", F.struct("doc_id", "tkey", "line_no").alias("place"),
                          _end_keys(F.col("line"), F.col("own"), F.col("shorter")).alias("ends"))
             .groupBy("h1", "h2").agg(F.min(F.struct("place", "ends")).alias("m"))
             .select("h1", "h2", "m.place.*", "m.ends"))
    first = stage(first, "line-first")
    near = stage(near_lines(lines, first), "line-near")
    kept = (first.drop("ends").join(small_side(near), ["h1", "h2"], "left_anti")
            .groupBy("doc_id", "tkey").agg(F.collect_list("line_no").alias("_kept"))
            .withColumnRenamed("tkey", "_tkey"))
    keyed = docs.withColumns({"_tkey": F.when(F.col("text").isNotNull(), text_key("text")),
                              "_all_lines": F.split("text", "\n")})
    joined = null_safe(keyed, kept, ["doc_id", "_tkey"], "left")
    # kept lines have words, so the places of lines without are others
    blank = F.filter(F.transform("_all_lines", lambda x, i: F.when(~x.rlike(INK), i)), lambda i: i.isNotNull())
    places = F.sort_array(F.concat(F.coalesce("_kept", F.array().cast("array<int>")), blank))
    stays = F.transform(places, lambda i: F.get("_all_lines", i))
    return joined.withColumn("_stays", stays).drop("_kept", "_tkey")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents with ``text`` cut to its kept lines, and n_lines and n_kept
    (columns of those names are replaced)."""
    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_kept")]
    count = [F.when(F.col("text").isNull(), 0).otherwise(F.size(c)).alias(name)
             for c, name in (("_all_lines", "n_lines"), ("_stays", "n_kept"))]
    return _cut(docs).select(*own, *count, F.array_join("_stays", "\n").alias("text"))


def op2_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept and the remaining text of every document."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_kept", "text")


def unrepeated_documents(docs: DataFrame) -> DataFrame:
    """Documents with their repeated lines cut, columns as given (n_chars, if
    there, is that of the cut text); documents all of whose words were in
    repeated lines go."""
    cut = _cut(docs)
    inked = lambda lines: F.exists(lines, lambda x: x.rlike(INK))
    left = cut.where(F.col("text").isNull() | inked("_stays") | ~inked("_all_lines"))
    new = F.array_join("_stays", "\n")
    kind = dict(docs.dtypes).get("n_chars")
    changed = {"text": new, "n_chars": F.coalesce(F.char_length(new).cast(kind), F.col("n_chars")) if kind else None}
    return left.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


OP2_SQL = f"""
WITH l AS (
  SELECT doc_id, i - 1 AS line_no, s[i] AS line, regexp_extract_all(s[i], '[^\\x20\\x09-\\x0D]+') AS words,
         regexp_matches(s[i], '[^\\x20\\x09-\\x0D]') AS ink
  FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))
), d AS (
  SELECT words, min((doc_id, line_no)) AS place FROM l WHERE ink GROUP BY words
), o AS (
  SELECT words, len(words) AS n, row_number() OVER (ORDER BY place) AS lid FROM d
), v AS (
  SELECT lid, 0 AS gone, words AS key FROM o WHERE n >= {MIN_WORDS}
  UNION ALL
  SELECT lid, i AS gone, list_concat(words[1:i - 1], words[i + 1:n]) AS key
  FROM (SELECT lid, n, words, unnest(generate_series(1, n)) AS i FROM o WHERE n >= {MIN_WORDS})
), near AS (
  SELECT DISTINCT b.lid FROM v a JOIN v b ON a.key = b.key AND a.lid < b.lid
  WHERE a.gone = b.gone OR a.gone = 0 OR b.gone = 0
), kept AS (
  SELECT place[1] AS doc_id, place[2] AS line_no
  FROM (SELECT place, row_number() OVER (ORDER BY place) AS lid FROM d) WHERE lid NOT IN (SELECT lid FROM near)
), stays AS (
  SELECT l.doc_id, l.line_no, l.line FROM l LEFT JOIN kept USING (doc_id, line_no)
  WHERE NOT l.ink OR kept.doc_id IS NOT NULL
), t AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY line_no) AS text FROM stays GROUP BY doc_id
)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS INTEGER) AS n_lines,
       CAST(coalesce(t.n_kept, 0) AS INTEGER) AS n_kept,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text
FROM documents d LEFT JOIN t USING (doc_id)
"""
