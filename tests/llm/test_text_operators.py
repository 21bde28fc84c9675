"""The text operators against brute force, libraries and held-out accuracy, and
on tables with nulls, empty and long texts, ties, repeated rows, no rows and
extra columns of clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventlab.llm import (bpe, fingerprints, language, language_model, line_dedup, mixing, near_dedup, suffix_dedup,
                          topk, toxicity)
from eventlab.llm.common import fold_remainder
from eventlab.llm.components import components
from eventlab.sources.files import read_table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHES = ("n", "size", "score", "label", "words", "n_lines", "_right_text", "sid", "tkey", "k0", "copies")


def _prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def messy(spark):
    rng = random.Random(4)
    base = _prose(rng, 90)
    line = _prose(rng, 12)
    texts = [None, "", "   \n\t", base, base, base.replace(base.split()[40], "other", 1), f"{line}\nshort\n{line}",
             line + "\n" + line.replace(line.split()[3], "new", 1), "one two", "é" * 50 + "\n" + _prose(rng, 30),
             " ".join([_prose(rng, 400)] * 40), "12 34 $$ !!", _prose(rng, 300)]
    rows = [(k, t, rng.choice(["aa", "bb", None]), rng.choice(["s1", "s2", None]), len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base, "aa", None, 0), (None, None, None, None, None), (7, _prose(rng, 60), "bb", "s1", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (3, 0, 1), (4, 1, 1), (5, 1, 0), (None, 1, 1), (8, None, None)],
                                 "doc_id long, quality int, toxic int")


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


CONTRACT = {
    "op1": ({"doc_id", "held_out", "score", "predicted"}, lambda d, l: toxicity.op1_toxicity(d, l)),
    "op2": ({"doc_id", "n_lines", "n_kept", "text"}, lambda d, l: line_dedup.op2_line_dedup(d)),
    "op3": ({"doc_id", "n_shingles", "component_id", "kept"}, lambda d, l: near_dedup.op3_near_dedup(d)),
    "op4": ({"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
            lambda d, l: language_model.op4_lm_score(d)),
    "op6": ({"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, lambda d, l: bpe.op6_bpe(d)),
    "op7": ({"doc_id", "held_out", "lang_pred", "score"}, lambda d, l: language.op7_language(d)),
    "op8": ({"doc_id", "size", "source_size", "target", "taken"}, lambda d, l: mixing.op8_source_mixing(d)),
    "op10": ({"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
             lambda d, l: fingerprints.op10_fingerprints(d)),
}


@pytest.mark.parametrize("name", CONTRACT)
def test_one_row_per_input_row(spark, messy, empty, labels, name):
    columns, op = CONTRACT[name]
    wide = messy.selectExpr("*", *[f"'x' AS {c}" for c in CLASHES])
    got = op(wide, labels)
    assert columns <= set(got.columns)
    rows = got.collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in messy.collect())
    none = op(empty, labels.limit(0))
    assert columns <= set(none.columns) and none.count() == 0


@pytest.mark.parametrize("op", [language.keep_identified, line_dedup.unrepeated_documents, near_dedup.one_of_each,
                                mixing.mixed_documents])
def test_stages_keep_columns(messy, empty, op):
    wide = messy.selectExpr("*", *[f"'x' AS {c}" for c in CLASHES])
    got = op(wide)
    assert got.columns == wide.columns
    assert {r["doc_id"] for r in got.collect()} <= {r["doc_id"] for r in messy.collect()}
    assert op(empty).count() == 0


# ---- line de-duplication


def _near_line(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < line_dedup.MIN_WORDS or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def test_line_dedup_is_brute_force(spark):
    rng = random.Random(1)
    pool = [_prose(rng, rng.randint(1, 14)).split() for _ in range(25)]
    docs = []
    for k in range(60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            w = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w[at:at + rng.randint(0, 1)] = rng.choice([[], ["zz"], [rng.choice("xyz")]])
            lines.append(" ".join(w))
        docs.append((k, "\n".join(lines)))
    got = {r["doc_id"]: r for r in line_dedup.op2_line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    seen = []
    for k, text in docs:
        keep = []
        for line in text.split("\n"):
            w = line.split()
            if not w or not any(_near_line(w, s) for s in seen):
                keep.append(line)
            seen += [w] * bool(w)
        assert got[k]["text"] == "\n".join(keep) and got[k]["n_kept"] == len(keep)


def test_line_dedup_compares_words_in_any_white_space(spark):
    rng = random.Random(11)
    pool = [_prose(rng, n).split() for n in (1, 2, 3, 5, 6, 7, 9, 12)]
    gaps = [" ", "  ", "\t", " \t ", "\x0b", "\x0c"]
    docs = []
    for k in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            w = list(rng.choice(pool))
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice("xyz")
            line = "".join(x + rng.choice(gaps) for x in w[:-1]) + w[-1]
            lines.append(rng.choice(["", "    ", "\t"]) + line + rng.choice(["", "\r", " "]))
        docs.append((k, "\n".join(lines + [" \t\r"])))
    got = {r["doc_id"]: r for r in line_dedup.op2_line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    seen = []
    for k, text in docs:
        keep = []
        for line in text.split("\n"):
            w = line.split()
            if not w or not any(_near_line(w, s) for s in seen):
                keep.append(line)
            seen += [w] * bool(w)
        assert got[k]["text"] == "\n".join(keep) and got[k]["n_kept"] == len(keep)


def test_line_dedup_is_native(messy):
    plan = line_dedup.op2_line_dedup(messy)._jdf.queryExecution().toString() + \
        mixing.op8_source_mixing(messy)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))


# ---- near duplicates


def _shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def _brute_components(docs, width):
    sets = [_shingles(t, width) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sets, [docs[find(k)][0] for k in range(len(docs))]


@pytest.mark.parametrize("small, medium, cross", [(64, 4096, 64), (6, 12, 2)])
def test_near_dedup_is_brute_force(spark, monkeypatch, small, medium, cross):
    """With small bounds the leaders, the cross pairs and the branching do the work."""
    for name, value in (("SMALL", small), ("MEDIUM", medium), ("CROSS", cross)):
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(2)
    docs = []
    common = _prose(rng, 60)
    for g in range(6):
        base = _prose(rng, 120).split()
        for _ in range(rng.choice([1, 3, 20])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = _prose(rng, 1)
            docs.append((len(docs), " ".join(w)))
    docs += [(len(docs) + k, common + " " + _prose(rng, rng.randint(5, 60))) for k in range(25)]
    docs += [(len(docs) + k, t) for k, t in enumerate(["a b", "a b", "A  b", "", None])]
    got = {r["doc_id"]: r for r in near_dedup.op3_near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets, labels = _brute_components(docs, 4)
    for k, (doc_id, _) in enumerate(docs):
        assert got[doc_id]["n_shingles"] == len(sets[k])
        assert got[doc_id]["component_id"] == labels[k]
        assert got[doc_id]["kept"] == (labels[k] == doc_id)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent if any(x in p and p[0] != p[1] for p in links)}


def test_one_of_each_judges_texts_of_one_id_alone(spark):
    rng = random.Random(14)
    a, b, c, d = (_prose(rng, 60) for _ in range(4))
    rows = [(1, a), (2, b), (2, a), (2, b), (3, c), (3, d), (4, "x"), (4, "y"), (4, "y"), (5, b), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in near_dedup.one_of_each(docs).collect())
    assert got == Counter([(1, a), (2, b), (3, c), (3, d), (4, "x"), (4, "y"), (None, a)])


# ---- repeated passages


def test_suffix_spans_are_brute_force(spark):
    rng = random.Random(5)
    passage = [_prose(rng, n).split() for n in (55, 80, 49, 120)]
    docs = []
    for k in range(40):
        w = _prose(rng, rng.randint(0, 80)).split()
        for p in rng.sample(passage, rng.randint(0, 2)):
            w += p + _prose(rng, rng.randint(1, 30)).split()
        docs.append((k, " ".join(w)))
    docs += [(50, docs[3][1]), (51, " ".join(passage[1] + passage[1])), (52, None), (53, "")]
    got = defaultdict(set)
    for r in suffix_dedup.op5_suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    holders = defaultdict(set)
    length = suffix_dedup.MIN_WORDS
    words = {k: (t or "").split() for k, t in docs}
    for k, w in words.items():
        for i in range(len(w) - length + 1):
            holders[tuple(w[i:i + length])].add(k)
    for k, w in words.items():
        want = {j for i in range(len(w) - length + 1) if len(holders[tuple(w[i:i + length])]) > 1 for j in range(i, i + length)}
        assert got[k] <= want
        assert len(got[k]) >= 0.95 * len(want) and bool(got[k]) == bool(want)


def test_suffix_spans_of_long_runs(spark):
    """Texts that repeat a passage hundreds of times, before or after its only
    other holder, over few and many partitions."""
    rng = random.Random(12)
    docs, want = [], []
    for k in range(6):
        passage = _prose(rng, 75).split()
        many = [passage + _prose(rng, 3).split() for _ in range(300)]
        docs += [(2 * k, " ".join(sum(many, []))), (2 * k + 1, " ".join(_prose(rng, 20).split() + passage))]
        want.append({78 * j + i for j in range(300) for i in range(75)})
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = defaultdict(set)
            for r in suffix_dedup.op5_suffix_dedup(frame).collect():
                got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
            for k in range(6):
                assert got[2 * k] == want[k] and got[2 * k + 1] == set(range(20, 95))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# ---- language model


def test_lm_counts_and_base(spark):
    docs = read_table(spark, SF, "documents").unionByName(
        spark.createDataFrame([(900_001, None, None, None, None), (900_002, "", None, None, 0), (900_002, "", None, None, 0)], SCHEMA))
    got = language_model.op4_lm_score(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    words = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [b" "]) for r in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter(w for i, ws in words if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = defaultdict(list)
    for i, ws in words:
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        want[i].append((len(ws), sum(count[w] > 0 for w in ws), base))
    assert len(got) == len(rows)
    better = 0.0
    for r in got:
        size, known, base = want[r["doc_id"]][0]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (size, known, n, held(r["doc_id"]))
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and math.isfinite(r["score"])
        better += (r["score"] - r["base_score"]) * r["held_out"]
    assert better > 0


def test_lm_score_equals_a_plain_model(spark):
    """Every word's path walked choice by choice with the fitted weights."""
    docs = read_table(spark, SF, "documents").select("doc_id", "text")
    held = language_model.fold_remainder("doc_id", 10) == 0
    got = {r["doc_id"]: r["score"] for r in language_model.op4_lm_score(docs).collect()}
    classes, weights, counts, _, _ = language_model.fit(docs.where(~held))
    count = {r["w"] % 2**64: r["c"] for r in counts.collect()}
    leaf_of = dict(zip(classes.words.tolist(), classes.leaves.tolist()))
    mix, bits, odd = language_model.mix64, len(weights).bit_length() - 1, 0xD6E8FEB86659FD93
    one = lambda x: int(mix(np.array([x % 2**64], np.uint64))[0])
    rows = docs.where(held).collect()
    assert len(rows) > 10
    for r in rows[:12]:
        words = next(language_model.text_words(pa.array([r["text"]])))[2].tolist()
        start, score = int(language_model.START_HASH), 0.0
        for k, w in enumerate(words):
            v, u = words[k - 1] if k else start, words[k - 2] if k > 1 else start
            leaf = leaf_of.get(w, classes.own + (w >> 56))
            lo = classes.first[leaf]
            for at in range(lo, lo + classes.length[leaf]):
                node = one((int(classes.nodes[at]) + 1) * 0x9E3779B97F4A7C15)
                z = classes.bias[classes.nodes[at]].astype(float)
                for f in (one(v + 1), one(u + 2)):
                    z = z + weights[((f ^ node) * odd % 2**64) >> (64 - bits)]
                z = np.clip(z, -40, 40)
                score += (z[classes.members[at]] - math.log(np.exp(z).sum())) / math.log(10)
            if leaf >= classes.own:
                score += math.log10(count.get(w, 0) + 0.1) - classes.shared_totals[leaf - classes.own]
        assert got[r["doc_id"]] == pytest.approx(score, rel=1e-4)


def test_lm_probabilities_sum_to_one():
    """Over all leaves after any history, and over the words of a shared leaf."""
    rng = np.random.default_rng(0)
    for n in (1, 2, 16, 17, 500):
        leaf_weights = rng.integers(1, 1000, n).astype(float)
        first, length, nodes, members = language_model.code_paths(leaf_weights)
        bias = language_model.class_bias(leaf_weights, first, length, nodes, members)
        weights = rng.normal(size=(len(bias), 16))
        z = np.where(bias > math.log(2e-13), bias + weights, -40)
        log_p = z - np.log(np.exp(z).sum(1, keepdims=True))
        total = sum(math.exp(sum(log_p[c, m] for c, m in zip(nodes[f:f + k], members[f:f + k]))) for f, k in zip(first, length))
        assert total == pytest.approx(1, abs=1e-9)
        plain = sum(math.exp(sum(bias[c, m] for c, m in zip(nodes[f:f + k], members[f:f + k]))) for f, k in zip(first, length))
        assert plain == pytest.approx(1, abs=1e-4)


def test_lm_places_words_like_a_search():
    rng = np.random.default_rng(3)
    words = np.unique(np.concatenate([rng.integers(0, 2**63, 5000, dtype=np.uint64) << np.uint64(1), np.arange(40, dtype=np.uint64)]))
    paths = language_model.code_paths(np.ones(300))
    classes = language_model.Classes(words, np.ones(len(words)), np.arange(len(words)), 44, *paths, np.zeros((1, 16)), np.zeros(256))
    asked = np.concatenate([words[::3], rng.integers(0, 2**63, 2000, dtype=np.uint64), words[:5] + np.uint64(1)])
    leaf, at = classes.place(asked)
    for w, one, k in zip(asked.tolist(), leaf.tolist(), at.tolist()):
        where = int(np.searchsorted(words, np.uint64(w)))
        known = where < len(words) and int(words[where]) == w
        assert (k, one) == ((where, where) if known else (-1, 44 + (w >> 56)))


def test_lm_learns_pairs_of_ordinary_words(spark):
    """Only the words before tell which one follows."""
    rng = random.Random(8)
    heads = [f"q{k}x" for k in range(400)]
    tails = [f"{k}zz" for k in range(400)]
    common = " ".join(f"c{k}" for k in range(200))
    train = [f"{heads[k]} mid {tails[k]} {heads[k]}{tails[k]}" for k in range(400)] * 3 + [common] * 20
    rng.shuffle(train)
    ids = [k for k in range(20_000) if zlib.crc32(str(k).encode()) % 10]
    held = [k for k in range(20_000) if not zlib.crc32(str(k).encode()) % 10]
    right, wrong = f"{heads[5]} mid {tails[5]}", f"{heads[5]} mid {tails[6]}"
    pair, other = f"{tails[5]} {heads[5]}{tails[5]}", f"{tails[5]} {heads[6]}{tails[6]}"
    rows = list(zip(ids, train)) + list(zip(held, (right, wrong, pair, other)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in language_model.op4_lm_score(docs).collect()}
    assert score[held[0]] > score[held[1]] + 1  # a skip pair
    assert score[held[2]] > score[held[3]] + 1  # a bigram


def test_lm_training_tasks_follow_the_tokens_of_a_round(spark, monkeypatch):
    """A task hands on a whole table's changes, so there is one for every TASK_TOKENS
    that a round reads, and five times the tokens make no more than five times the tasks."""
    a_task = language_model.TASK_TOKENS * language_model.ROUNDS
    for tokens in (0, 1, a_task, a_task + 1, 23_900_000, 119_900_000, 7_000_000_000):
        tasks = language_model.round_tasks(tokens)
        assert tasks == max(1, math.ceil(tokens / a_task))
        assert language_model.round_tasks(5 * tokens) <= 5 * tasks
    asked, tasks_of = [], language_model.round_tasks
    monkeypatch.setattr(language_model, "round_tasks", lambda tokens: asked.append(tokens) or tasks_of(tokens))
    docs = spark.createDataFrame([(k, f"a b{k % 7} c") for k in range(60)], "doc_id long, text string").repartition(4)
    rows = language_model.op4_lm_score(docs).collect()
    assert len(rows) == 60 and set(asked) == {r["train_tokens"] for r in rows}


def test_lm_counts_of_joined_words(spark, monkeypatch):
    """Counts and base are the same whether a word's count is broadcast or joined, and
    a run gives the same scores again."""
    docs = read_table(spark, SF, "documents")
    columns = ("doc_id", "n_tokens", "n_known", "train_tokens")
    every = []
    for most in (400_000, 5, 5):
        monkeypatch.setattr(language_model, "KNOWN_WORDS", most)
        every.append({r["doc_id"]: r for r in language_model.op4_lm_score(docs).collect()})
    for d, r in every[0].items():
        assert [r[c] for c in columns] == [every[1][d][c] for c in columns]
        assert r["base_score"] == pytest.approx(every[1][d]["base_score"], rel=1e-9)
        assert every[2][d]["score"] == pytest.approx(every[1][d]["score"], rel=1e-9)


# ---- byte-pair encoding


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary()), bpe.load(open(bpe.default_vocabulary(), encoding="utf-8").read())


def _same(tokenizer, text):
    theirs, ours = tokenizer
    ids = ours.encode([text])[0]
    want = theirs.encode(text, add_special_tokens=False).ids
    assert ids.tolist() == want
    assert ours.decode(ids) == theirs.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FFF, categories=("L", "N", "P", "S", "Z", "M")), max_size=60))
def test_bpe_is_the_library_any_text(tokenizer, text):
    _same(tokenizer, text)


def test_bpe_is_the_library(spark, tokenizer):
    for r in read_table(spark, SF, "documents").select("text").limit(120).collect():
        _same(tokenizer, r["text"])
    for text in ("", "a" * 3000, "<|endoftext|>x<|startoftext|> <|endo", "ΑΣ ΣΑΣ", "it's we'll 'd 12½", "\x1c \x85 ", "İI"):
        _same(tokenizer, text)


def test_bpe_digests_and_round_trip(spark, tokenizer, messy):
    theirs, _ = tokenizer
    texts = {r["doc_id"]: r["text"] or "" for r in messy.where("doc_id <> 7").collect()}
    for r in bpe.op6_bpe(messy.where("doc_id <> 7")).collect():
        ids = theirs.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode_texts(messy, ["doc_id"], ["ids", "decoded"])
    want = Counter((r["doc_id"], r["decoded"]) for r in encoded.collect())
    assert Counter((r["doc_id"], r["decoded"]) for r in bpe.decode_ids(encoded).collect()) == want


# ---- language


def test_language_held_out_accuracy(spark):
    docs = read_table(spark, SF, "documents")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = [r for r in language.op7_language(docs).collect() if r["held_out"]]
    assert rows and sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("texts", [["a"], ["7 x"], ["", "a", "longer text here", "7 x", "12 !", "é", "b"]])
def test_language_of_single_letters(texts):
    table = np.full((language.BUCKETS, 3), 1 / language.BUCKETS, np.float32)
    names, _ = language.infer(texts, ["aa", "bb"], table)
    assert [n == "und" for n in names] == [not any(c.isalpha() for c in t) for t in texts]


def test_language_mixture_and_unknown(spark):
    docs = read_table(spark, SF, "documents")
    one = {x: docs.where(f"lang = '{x}'").orderBy("n_chars", ascending=False).first()["text"][:3000] for x in ("en", "fr")}
    langs, table = language.learn(docs, fold_remainder("doc_id", 3) != 1)
    names, score = language.infer([one["en"], one["en"] + " " + one["fr"], "", "12 !", "  "], langs, table)
    assert names[0] == "en" and score[0] > 0.9
    assert names[1] in ("en", "fr") and 0.3 < score[1] < 0.7
    assert names[2:] == ["und"] * 3 and score[2:].tolist() == [0, 0, 0]
    assert language.infer(["abc"], [], np.ones((language.BUCKETS, 1), np.float32))[0] == ["und"]


# ---- toxicity


def test_folding():
    assert toxicity.fold("Yоu 1D10T, l0ser!") == " you idiot loser "
    assert toxicity.fold("ｍｏｒｏｎ $cum vеjüte$$$ 12") == " moron scum vejute "


def test_exceptions_and_longest_entry():
    found = toxicity.automaton({" trash": 3.0, " idiot": 2.0, " idiotic": 5.0})
    assert toxicity.weigh(toxicity.fold("a trash can and trash"), found) == 3.0
    assert toxicity.weigh(toxicity.fold("idiotic idiots"), found) == 7.0
    assert toxicity.weigh(toxicity.fold("patrash"), found) == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, marks = read_table(spark, sf, "documents"), read_table(spark, sf, "labels")
    truth = {r["doc_id"]: r["toxic"] for r in marks.collect()}
    rows = [r for r in toxicity.op1_toxicity(docs, marks).collect() if r["held_out"] and r["doc_id"] in truth]
    clean = [r for r in rows if not truth[r["doc_id"]]]
    assert not any(r["predicted"] for r in clean)
    assert sum(r["predicted"] for r in rows) >= 0.7 * (len(rows) - len(clean))


def test_toxicity_learns_rare_terms_of_texts_with_shared_lines(spark):
    """A word in 11 of 1,200 toxic texts and no clean one is an entry, and texts that
    share a line are texts of their own."""
    rng = random.Random(13)
    shared = "this very long line stands in every one of the texts, as license lines do in many"
    rows = [(k, f"{shared}\n{_prose(rng, 12)}" + (" zorblax" if k < 11 else "")) for k in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 1_200)) for k in range(3_000)], "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(docs, labels, F.lit(True))
    assert any(" zorblax ".startswith(term) for term in lexicon)
    assert not any(term.startswith(" license") for term in lexicon)


# ---- mixing


def test_targets_share_by_weight(spark):
    totals = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1000), (None, 50), ("d", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(totals).collect()}
    left, open_, want = 1160.0, {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}, {}
    cap = {"a": 300, "b": 30, "c": 3000, "d": 0, None: 150}
    while True:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] > cap[s]]
        if not over:
            break
        for s in over:
            want[s] = cap[s]
            left -= cap[s]
            del open_[s]
    assert got == pytest.approx(want | share)


def test_mix_meets_targets_and_reruns(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    rows = mixing.op8_source_mixing(docs).collect()
    again = mixing.op8_source_mixing(docs.repartition(7)).collect()
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in again}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    taken, target, most = Counter(), {}, Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        most[s] = max(most[s], r["size"])
    for s in target:
        assert abs(taken[s] - target[s]) <= most[s]
    assert mixing.mixed_documents(docs).count() == sum(r["copies"] for r in rows)


def test_pivotal_rounding_keeps_expectations(spark):
    units = spark.createDataFrame([("s", k, 0, 1 + k % 7, 0.3) for k in range(70)], "source string, doc_id long, tkey long, words long, p double")
    hits = Counter()
    for seed in range(12):
        for r in mixing.pivotal_round(units, seed, fan_in=8).collect():
            hits[seed] += r["x"] * (1 + r["doc_id"] % 7)
    want = 0.3 * sum(1 + k % 7 for k in range(70))
    assert all(abs(h - want) < 7 for h in hits.values())


# ---- top-k


def test_topk_is_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.integers(-3, 4, 8) / 64 if True], 0) for k in range(300)]
    rows += [(300, None, 0), (301, [1.0, None] * 4, 0), (302, [float("nan")] * 8, 0), (320, [0.5, 0.25], 0), (321, [0.5, 1.0], 0),
             (None, [0.1] * 8, 0), (299, [0.2] * 8, 0)]
    got = defaultdict(list)
    for r in topk.op9_topk_search(_vectors(spark, rows)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    fine = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, _ in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for i, q in fine:
        if i % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in fine if j != i and len(x) == len(q))[:20]
            assert got[i] == [(k + 1, j, -s) for k, (s, j) in enumerate(near)]
    assert set(got) == {i for i, _ in fine if i % 20 == 0}
    assert topk.op9_topk_search(_vectors(spark, [])).count() == 0


def test_topk_large_values_and_blocks(spark):
    rows = [(k, [1e6 * (k + 1), -1.0], 0) for k in range(0, 60, 10)]
    vectors = topk.usable(_vectors(spark, rows))
    got = topk.top_k(vectors, vectors, k=2, block=2).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got][:4] == [50, 40, 50, 40] and len(got) == 12


# ---- fingerprints


def test_fingerprints_of_texts_and_edits(spark, messy):
    docs = messy.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = [(r["doc_id"], r["text"] or "") for r in docs.orderBy("doc_id").collect()]
    got = {r["doc_id"]: r for r in fingerprints.op10_fingerprints(docs).collect()}
    for k, (i, t) in enumerate(texts):
        half = len(t) // 2
        edited = t[:len(t) - half] + texts[(k + 1) % len(texts)][1][:half]
        assert got[i]["n_chars"] == len(t)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    for i, t in texts:
        for j, u in texts:
            assert (got[i]["fingerprint"] == got[j]["fingerprint"]) == (t == u or sorted(t.split("\n")) == sorted(u.split("\n")))


def test_fingerprint_is_homomorphic():
    import pyarrow as pa

    def of(text):
        return fingerprints.encode(*fingerprints.fingerprint_texts(pa.array([text])))[0]

    assert of("a b c d\ne f g h\na b c d") == of("e f g h\na b c d\na b c d") != of("e f g h\na b c d")
    assert fingerprints.combine(of("a b c\nd e f g"), of("x y z w")) == of("x y z w\na b c\nd e f g")
    assert fingerprints.combine(of("a b c\nd e f g"), of("a b c"), -1) == of("d e f g")


def test_fingerprint_lanes_of_long_repetitive_texts():
    """A run that occurs 40,000 times is still like itself 20,000 times."""
    a, b = (fingerprints.fingerprint_texts(pa.array(["aa bb cc\n" * n + "dd ee ff"])) for n in (40_000, 20_000))
    assert fingerprints.likeness(*a, *b)[0] > 0.99
    assert np.abs(a[1].view(np.int32)).max() == 40_000
    text = fingerprints.encode(*a)[0]
    assert (fingerprints.decode(text)[1] == a[1][0]).all()


def test_line_dedup_of_very_long_lines_and_texts(spark):
    rng = random.Random(21)
    words = [_prose(rng, 1) for _ in range(20_000)]
    edited = words[:9_000] + ["new"] + words[9_001:]
    shorter = words[:15_000] + words[15_001:]
    other = words[:100] + ["two", "edits"] + words[102:]
    mid = [_prose(rng, 1) for _ in range(line_dedup.LONG + 1)]
    lines = [" ".join(w) for w in (words, edited, shorter, other, mid, mid[:300] + mid[301:], mid[:-1] + ["last"], mid + ["more"])]
    many = [_prose(rng, 3) for _ in range(5_000)]
    docs = [(k, x) for k, x in enumerate(lines)] + [(100, "\n".join(many + many[:2500]))]
    got = {r["doc_id"]: r for r in line_dedup.op2_line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[k]["n_kept"] for k in range(8)] == [1, 0, 0, 1, 1, 0, 0, 0]
    assert got[100]["n_lines"] == 7_500 and got[100]["text"] == "\n".join(dict.fromkeys(many))


def test_line_dedup_oracle_on_uneven_lines(spark, tmp_path):
    import duckdb
    rng = random.Random(6)
    base = [_prose(rng, 8) for _ in range(12)]
    rows = []
    for k in range(60):
        w = rng.choice(base).split()
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = "odd"
        rows.append((k, "\n".join([rng.choice([" ", "  ", "\t", "\r"]).join(w) + rng.choice(["", "\r", " "]), "  \t", "a\tb", rng.choice(base)])))
    rows += [(60, None), (61, ""), (62, "a  b\r")]
    got = sorted(map(tuple, line_dedup.op2_line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = con.sql(line_dedup.OP2_SQL)
    assert got == sorted(tuple(dict(zip(want.columns, r))[c] for c in ("doc_id", "n_lines", "n_kept", "text")) for r in want.fetchall())


def test_topk_of_empty_vectors_and_clashing_names(spark):
    rows = [(0, [], 1), (20, [], 1), (3, [], 1), (40, [1.0, 2.0], 1), (5, [1.0, 2.0], 2), (6, None, 1), (7, [float("nan"), 1.0], 1)]
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.op9_topk_search(
        spark.createDataFrame([(*r, 9, 9, 9) for r in rows], "vec_id long, embedding array<float>, label int, score int, rank int, query_id int")).collect()}
    assert got == {(0, 1, 3, 0), (0, 2, 20, 0), (20, 1, 0, 0), (20, 2, 3, 0), (40, 1, 5, 64 * 64 * 5)}
    assert topk.op9_topk_search(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def _repeated_words(docs, length=suffix_dedup.MIN_WORDS):
    words = {k: (t or "").split() for k, t in docs}
    holders = defaultdict(set)
    for k, w in words.items():
        for i in range(len(w) - length + 1):
            holders[tuple(w[i:i + length])].add(k)
    return {k: {j for i in range(len(w) - length + 1) if len(holders[tuple(w[i:i + length])]) > 1 for j in range(i, i + length)}
            for k, w in words.items()}


def test_suffix_spans_of_partial_copies(spark):
    """Heads and tails of a passage in other texts, which are nearer in order than
    the texts that hold all of it."""
    rng = random.Random(33)
    docs = []
    for _ in range(30):
        passage = _prose(rng, 60).split()
        for _ in range(2):
            docs.append((len(docs), " ".join(_prose(rng, rng.randint(5, 30)).split() + passage + _prose(rng, rng.randint(5, 30)).split())))
        for cut in range(12, 58, 5):
            part = passage[cut:] if rng.random() < 0.6 else passage[:cut]
            docs.append((len(docs), " ".join(_prose(rng, 10).split() + part + _prose(rng, 10).split())))
    docs += [(len(docs), docs[0][1]), (len(docs) + 1, docs[0][1]), (3, docs[0][1]), (None, docs[5][1]), (None, None)]
    rows = [(k, t, 1, 2, 3) for k, t in docs]
    got = defaultdict(set)
    for r in suffix_dedup.op5_suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string, pos int, code long, tkey long")).collect():
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    want = _repeated_words([*docs[:-3], ("3, other text", docs[0][1]), (None, docs[5][1])])
    for k, w in want.items():
        assert k in (3, "3, other text") or got[k] == w, k
    assert suffix_dedup.op5_suffix_dedup(spark.createDataFrame([], "doc_id long, text string, pos int")).count() == 0
