"""Lexical search, the conversation trie and benchmark windows against brute force,
with nulls, empty and long texts, ties, repeated rows, no rows and extra columns of
clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from eventlab.llm import decontamination, lexical_search, prefix_trie

DOCS = "doc_id long, text string, lang string, at int, n int, words int, h int, key long, query int"
ITEMS = "item_id long, text string, phrase string, len int, term long"
TURNS = "conv_id long, turn long, role string, text string, at int, chunk int, k1 long, size int, level int"

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def _prose(rng, n, letters="abcdeé"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) for _ in range(n))


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, 2, 3, 4, 5, 6) for d, t in rows], DOCS)


def _items(spark, rows):
    return spark.createDataFrame([(i, t, "p", 1, 2) for i, t in rows], ITEMS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    items = [_prose(rng, n) for n in (40, 25, 12, 10, 10, 3, 1, 60)]
    rows = [(k, _prose(rng, rng.randint(0, 120))) for k in range(120)]
    for k in range(120, 160):
        own, item = _prose(rng, 40), rng.choice(items)
        part = item.split()[rng.randint(0, 5):][:rng.randint(5, 40)]
        rows.append((k, own[:60] + " " + " , ".join(part).upper().replace("É", "é") + "\n" + own[60:]))
    rows += [(200, None), (201, ""), (202, " .,;\n\t"), (203, items[0]), (203, items[1]), (204, items[0] * 3), (205, items[0]), (205, items[0]),
             (None, items[0]), (None, None), (206, "É " + items[2].replace(" ", "\x7f")), (207, " ".join([items[3]] * 400)),
             (208, _prose(rng, 30_000)), (209, items[5]), (210, "x" * 70_000 + " " + items[2])]
    asked = [(k, t) for k, t in enumerate(items)] + [(3, items[3]), (20, items[1]), (10, items[0]), (None, items[0]), (30, None), (31, "  "),
                                                    (32, items[0][:50]), (-4, "ÉÈ Kelvin K k"), (33, "the one"), (33, "one two")]
    return rows, asked


# benchmark windows


def _contaminated(rows, asked, size=10):
    windows = defaultdict(set)
    for i, t in asked:
        w = _words(t)
        if i is not None and w:
            for k in range(max(len(w) - size, 0) + 1):
                windows[tuple(w[k:k + size])].add(str(i))
    out = []
    for d, t in rows:
        w, hit, items = _words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                held = windows.get(tuple(w[k:k + n]))
                if held:
                    hit |= set(range(k, k + n))
                    items |= held
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out


def _key(row):
    return tuple((v is None, v or 0) for v in row)


def test_decontamination_is_brute_force(spark, corpus):
    rows, asked = corpus
    got = decontamination.op13_decontamination(_docs(spark, rows), _items(spark, asked))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = _contaminated(rows, asked)
    assert sorted(map(tuple, got.collect()), key=_key) == sorted(want, key=_key)
    assert sum(r[5] for r in want) > 20


def test_decontamination_joined_by_shuffles(spark, corpus, monkeypatch):
    rows, asked = corpus
    monkeypatch.setattr(decontamination, "small_side", lambda df: df)
    monkeypatch.setattr(decontamination, "light_side", lambda df, cost: df)
    got = decontamination.op13_decontamination(_docs(spark, rows), _items(spark, asked))
    assert sorted(map(tuple, got.collect()), key=_key) == sorted(_contaminated(rows, asked), key=_key)


def test_decontamination_of_empty_tables(spark, corpus):
    rows, asked = corpus
    none = decontamination.op13_decontamination(_docs(spark, rows), _items(spark, []))
    assert sorted(map(tuple, none.collect()), key=_key) == sorted(_contaminated(rows, []), key=_key)
    assert decontamination.op13_decontamination(_docs(spark, []), _items(spark, asked)).count() == 0


def test_decontamination_is_native(spark, corpus):
    rows, asked = corpus
    docs, items = _docs(spark, rows), _items(spark, asked)
    windows, _ = decontamination.benchmark_windows(items, 10)
    shingles = decontamination.window_shingles(windows)
    hits = decontamination.shingle_hits(docs, shingles)
    for df in (windows, shingles, hits, decontamination.candidate_windows(hits, shingles), decontamination.op13_decontamination(docs, items)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# lexical search


def _ranked(rows, asked, k=50):
    docs = [(d, Counter(_words(t))) for d, t in rows]
    n_docs, n_terms = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    queries = defaultdict(set)
    for i, t in asked:
        if i is not None:
            queries[i] |= set(_words(t))
    out = []
    for i, terms in queries.items():
        scores = []
        for d, c in docs:
            if d is not None and c:
                m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in terms if t in c)
                if s > 0:
                    scores.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("k, block", [(50, 200_000), (7, 30)])
def test_search_is_brute_force(spark, corpus, monkeypatch, k, block):
    rows, asked = corpus
    blocks = lexical_search.query_blocks
    monkeypatch.setattr(lexical_search, "query_blocks", lambda items: blocks(items, block))
    got = lexical_search.ranked(_docs(spark, rows), _items(spark, asked), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert dict(got.dtypes)["rank"] == "int" and dict(got.dtypes)["score"] == "bigint"
    assert sorted(map(tuple, got.collect())) == _ranked(rows, asked, k)


def test_search_of_empty_tables(spark, corpus):
    rows, asked = corpus
    assert lexical_search.op11_lexical_search(_docs(spark, []), _items(spark, asked)).collect() == []
    assert lexical_search.op11_lexical_search(_docs(spark, rows), _items(spark, [])).collect() == []
    assert lexical_search.op11_lexical_search(_docs(spark, [(1, None), (2, "")]), _items(spark, asked)).collect() == []


def test_bounds_are_never_below_scores():
    rng = random.Random(8)
    texts = [_prose(rng, rng.choice([1, 5, 50, 400])) for _ in range(lexical_search.ROWS)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    n, row, hashes, tf = lexical_search.term_counts(data, offsets)
    queries = lexical_search.Queries(list("abc"), [np.unique(rng.sample(hashes.tolist(), 30)).astype(np.uint64).view(np.int64).tolist() for _ in "abc"])
    df = np.array([np.unique(row[hashes == h]).size for h in queries.distinct])
    queries.weigh(len(texts), int(n.sum()), df)
    for width in (7, 9, 12):  # overfull, full and sparse signatures
        entries = [np.concatenate([lexical_search._entries(hashes[(row == r) & (tf >= least)], lv) for lv, least in enumerate(lexical_search.LEVELS)])
                   for r in range(len(texts))]
        bounds = queries.bounds(width, n, lexical_search.slices_of(entries, width))
        doc, query = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(3), indexing="ij"))
        scores = queries.scores(n, row, hashes, tf, doc, query)
        assert (bounds[query, doc] >= scores).all()
    # a sparse signature comes close
    assert (bounds[query, doc] <= 2.1 * scores + 100).mean() > 0.9


# conversations


def _trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    convs = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    paths = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ends = defaultdict(list)
    for c, p in paths.items():
        ends[p].append(c)
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
             hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()]


def _conversations(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-12, 90), 9000, 9001, 9004, 123456789]:
        hot = rng.random() < 0.5
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9, 12, 20])):
            rows.append((c, turn * 7, "u" if turn % 2 else "a", f"tést {turn}" if hot else rng.choice(["x", "yy", "zzz", "é"])))
    rows += [(4, None, "s", "first"), (4, 7, "u", "tie"), (4, 7, "a", "tie"), (4, 7, None, None), (4, 7, "u", "tie"), (None, 1, "u", "x"),
             (None, None, None, None), (41, 10**15, "u", "late"), (500, None, None, None)]
    rows += [(700, t, "u", f"turn {t}") for t in range(60)] + [(701, t, "u", f"turn {t}") for t in range(50)]
    return rows


@pytest.mark.parametrize("deep, heavy, chunk, queue", [(256, 4096, 4096, 1 << 18), (4, 6, 8, 1 << 18), (16, 10**6, 16, 3), (1, 0, 1, 2)])
def test_trie_is_brute_force(spark, monkeypatch, deep, heavy, chunk, queue):
    rows = _conversations()
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "PIECE", 16)
    if deep == 1:  # a level for each depth: fewer and shorter conversations
        rows = [r for r in rows if (r[0] or 0) < 20 and (r[1] or 0) < 30]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], TURNS)
    got = prefix_trie.prefix_trie(df, deep, heavy, queue)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for c, t in got.dtypes if c != "ends_sha256"} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=_key) == sorted(_trie(rows), key=_key)


def test_trie_of_no_and_turnless_conversations(spark):
    assert prefix_trie.op12_prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    alone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    rows = [(alone, 0, "u", "x")]  # its one turn is replaced by the first turns of an absent conversation
    got = prefix_trie.op12_prefix_trie(spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], TURNS))
    assert list(map(tuple, got.collect())) == _trie(rows)
    assert got.count() == 1


def test_queue_spills_and_keeps_order():
    rng = random.Random(1)
    messages = [((rng.randint(0, 30), rng.randint(0, 3)), rng.randint(0, 9), rng.randint(0, 9)) for _ in range(500)]
    queue = prefix_trie.SpillingQueue(16)
    for key, *values in messages:
        queue.push(key, *values)
    for key in sorted({m[0] for m in messages}):
        assert sorted(queue.take(key)) == sorted(m[1:] for m in messages if m[0] == key)
    assert not len(queue)
