"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, accents and look-alike letters to plain
Latin ones, invisible characters away, digits and signs that stand for letters
back to letters when a letter follows, everything else to one space. One
automaton then finds the entries, which are words or beginnings of words, and
the exception phrases, whose span is not counted. The longest entry at a word
counts with its weight; the sum is used as it is and per hundred words, and a
logistic curve over both gives the score.

Entries are a short fixed list and those learned from the training labels:
beginnings of words (4 to 8 letters) and whole words in at least ``MIN_TEXTS``
toxic texts, whose log-odds are high and hardly due to chance: the likelihood ratio
of their counts in both labels against the labels' shares is at least ``EVIDENCE``.
Only such entries reach the driver. Equal texts count once, so that copies don't
make words look toxic.

Defined cases: null and empty texts have no match and get the curve's lowest
score. Null labels are not learned from; with no labelled text of either kind
only the fixed list and a fixed curve are used. Repeated rows get a row each; a
document whose label rows disagree counts as toxic.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlab.llm.common import fold_remainder, small_side
from eventlab.sources.files import stage

# Words of contempt and their weights, and phrases that are harmless.
SEED_LEXICON = {"idiot": 4.0, "moron": 4.0, "stupid": 3.5, "loser": 3.5, "scum": 4.0, "trash": 3.0, "clown": 3.0,
                "pathetic": 3.5, "worthless": 3.5, "disgusting": 3.5}
EXCEPTIONS = ("trash can", "trash cans", "trash bag", "trash bags", "trash bin", "trash collection", "circus clown",
              "clown fish", "clownfish", "pond scum", "soap scum", "scumble", "trashed files")
# Letters of other scripts that look like Latin ones.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
              "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ɡ": "g", "α": "a", "ε": "e",
              "ο": "o", "ρ": "p", "υ": "u", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "χ": "x", "ı": "i", "ł": "l",
              "ø": "o", "ƒ": "f"}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
         "|": "l"}
INVISIBLE = "­​‌‍⁠﻿"

#: Toxic training texts that an entry is in at least; its least log-likelihood ratio (twice the logarithm) and log-odds weight.
MIN_TEXTS = 5
EVIDENCE = 15.0
MIN_WEIGHT = 2.5
MAX_WEIGHT = 8.0
PREFIXES = range(4, 9)
#: Distinct terms that a task counts before it hands them on.
FLUSH = 300_000
CUT = 0.7


def _letter_table() -> dict[int, str | None]:
    """Accented Latin letters by their decomposition, full-width forms by their
    offset, then the fixed values."""
    table: dict[int, str | None] = {}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFKD", chr(cp))[0]
        if base.isascii():
            table[cp] = base.lower()
    table |= {cp: chr(cp - 0xFEE0).lower() for cp in range(0xFF01, 0xFF5F)}
    table |= {cp: None for cp in range(0x300, 0x370)}
    return table | {ord(a): b for a, b in LOOKALIKES.items()} | {ord(c): None for c in INVISIBLE}


_LETTERS = _letter_table()
_SIGN = re.compile(r"(?<![^\W\d_])[0-9@$!|]+(?=[^\W\d_])|(?<=[^\W\d_])[013457@$!|]+(?=[^\W\d_])")
_HAS_SIGN = re.compile(r"[0-9@$!|][^\W\d_]")
_GAP = re.compile(r"[\W\d_]+")


def _sign(m: re.Match) -> str:
    return "".join(SIGNS.get(c, c) for c in m.group())


def fold(text: str) -> str:
    """Folded words, one space before and after each."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_LETTERS)
    if _HAS_SIGN.search(text):
        text = _SIGN.sub(_sign, text)
    return f" {_GAP.sub(' ', text).strip()} "


def terms_of(folded: str) -> set[str]:
    """Candidate entries of a text: " word" beginnings and " word " whole words."""
    found = set()
    for w in set(folded.split()):
        found.add(f" {w} ")
        found.update(f" {w[:n]}" for n in PREFIXES if n <= len(w))
    return found


def _count_terms(texts: DataFrame) -> DataFrame:
    """(term, n): texts that each term is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for b in batches:
            for text in b.column(0):
                count.update(terms_of(fold(text.as_py() or "")))
                if len(count) > FLUSH:
                    yield pa.record_batch([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())],
                                          names=["term", "n"])
                    count.clear()
        yield pa.record_batch([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())],
                              names=["term", "n"])

    return texts.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _usable_labels(labels: DataFrame) -> DataFrame:
    return (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))


def learn_lexicon(docs: DataFrame, labels: DataFrame, training: Column) -> dict[str, float]:
    """Entry -> weight, from one label row per doc_id. What reaches the driver are
    the terms with enough evidence."""
    lexicon = {f" {w}": x for w, x in SEED_LEXICON.items()}
    marked = docs.where(training & F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("tkey"))
    texts = stage(marked.join(small_side(labels), "doc_id"), "toxicity-training")
    once = stage(texts.groupBy("toxic", "tkey").agg(F.min(F.col("doc_id")).alias("doc_id")), "toxicity-once")
    texts = texts.join(small_side(once), ["toxic", "tkey", "doc_id"]).dropDuplicates(["toxic", "tkey"])
    size = dict(once.groupBy(F.col("toxic") > 0).count().collect())
    n_toxic, n_clean = size.get(True, 0), size.get(False, 0)
    if not n_toxic or not n_clean:
        return lexicon
    toxic = _count_terms(texts.where("toxic > 0").select("text")).where(F.col("n") >= MIN_TEXTS)
    clean = _count_terms(texts.where("toxic <= 0").select("text")).withColumnRenamed("n", "n_other")
    found = toxic.join(clean, "term", "left").withColumn("n_other", F.coalesce("n_other", F.lit(0)))
    share = n_toxic / (n_toxic + n_clean)
    a, b, n = F.col("n"), F.col("n_other"), F.col("n") + F.col("n_other")
    ratio = 2 * (a * F.log(a / (n * share)) + F.when(b > 0, b * F.log(b / (n * (1 - share)))).otherwise(0.0))
    weight = F.log((a + 0.5) / (n_toxic + 1)) - F.log((b + 0.5) / (n_clean + 1))
    rows = found.withColumn("weight", weight).where((F.col("weight") >= MIN_WEIGHT) & (ratio >= EVIDENCE)).select("term", "weight")
    toxic = dict(rows.collect())
    for term in sorted(toxic, key=lambda t: (len(t), t)):
        weight = toxic[term]
        shorter = max((lexicon.get(term[:n], 0.0) for n in range(2, len(term))), default=0.0)
        if min(weight, MAX_WEIGHT) > shorter + 0.5:
            lexicon[term] = min(weight, MAX_WEIGHT)
    return lexicon


def automaton(lexicon: dict[str, float]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in lexicon.items():
        found.add_word(term, (len(term), weight))
    for phrase in EXCEPTIONS:
        found.add_word(fold(phrase), (len(fold(phrase)), None))
    found.make_automaton()
    return found


def weigh(folded: str, entries: ahocorasick.Automaton) -> float:
    """Sum of the weights of the longest entry at each word outside exception phrases."""
    at: dict[int, tuple[int, float]] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in entries.iter(folded):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        elif size > at.get(start, (0, 0.0))[0]:
            at[start] = (size, weight)
    if spared:
        return sum(w for s, (_, w) in at.items() if not any(a <= s < b for a, b in spared))
    return sum(w for _, w in at.values())


def weigh_texts(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """(doc_id, total, density) of every row: summed weights, and per 100 words."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = automaton(pickle.loads(sent.value))
        for b in batches:
            total, words = [], []
            for text in b.column(1):
                folded = fold(text.as_py() or "")
                total.append(float(weigh(folded, entries)))
                words.append(folded.count(" ") - 1)
            total = np.array(total)
            density = 100 * total / (np.array(words) + 20)
            yield pa.record_batch([b.column(0), pa.array(total), pa.array(density)], names=["doc_id", "total", "density"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, total double, density double")


def fit_curve(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logistic coefficients (1, x...) by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, *[1e-1] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -4, 4)
    return beta


#: Without labels: the odds are even at a summed weight of 2.
DEFAULT_CURVE = np.array([-4.0, 3.6, 0.0])


def score_toxicity(docs: DataFrame, labels: DataFrame, training: Column) -> DataFrame:
    """(doc_id, total, density, score) of every row."""
    labels = stage(_usable_labels(labels), "toxicity-labels")
    lexicon = learn_lexicon(docs, labels, training)
    weighed = stage(weigh_texts(docs, lexicon), "toxicity-weights")
    x1, x2 = F.log1p("total"), F.log1p("density")
    # a bounded grid of cells stands for the labelled rows in the fit
    cells = (weighed.where(training).join(small_side(labels), "doc_id")
             .groupBy(F.round(x1 * 8).alias("a"), F.round(x2 * 8).alias("b"), (F.col("toxic") > 0).alias("y"))
             .agg(F.avg(x1).alias("x1"), F.avg(x2).alias("x2"), F.count(F.lit(1)).alias("n")).collect())
    beta = DEFAULT_CURVE
    if {r["y"] for r in cells} == {True, False}:
        beta = fit_curve(np.array([[r["x1"], r["x2"]] for r in cells]), np.array([float(r["y"]) for r in cells]),
                         np.array([float(r["n"]) for r in cells]))
    z = F.lit(float(beta[0])) + F.lit(float(beta[1])) * x1 + F.lit(float(beta[2])) * x2
    return weighed.withColumn("score", 1.0 / (1.0 + F.exp(-z)))


def op1_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns."""
    held_out = fold_remainder("doc_id", 3) == 1
    scored = score_toxicity(docs, labels, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= CUT).cast("int").alias("predicted"))
