"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of a word's tree hold the merge rank of each symbol with its right
neighbour, every node the smallest (rank, position) below it. The root is thus
the leftmost merge of lowest rank; merging changes three leaves and the paths
above them. Words of one padded length are merged in step as rows of numpy
arrays, so a merge costs a few vector operations of log(length) levels.

Texts become words as the vocabulary file says: its special tokens are cut out
of the raw text first; the rest is put in NFC and lower case character by
character, and words are the matches of the file's pattern. Decoding joins the
symbols of the ids by a space, as a file without a decoder asks for.

Defined cases: null and empty texts have no ids and decode to the empty text.
A text is read in pieces of bounded size; a worker keeps a bounded cache of
words it has met.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

#: Words kept by a worker; the cache is emptied beyond that.
CACHE_WORDS = 400_000
#: Characters of texts that are split into words at once.
PIECE_CHARS = 1 << 21
#: Cells of the trees that are merged in step.
TREE_CELLS = 1 << 20
NONE = np.int64(2**62)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files:
    printable Latin-1 bytes stand for themselves, the others for U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class SegmentTreeBpe:
    """Merges of one vocabulary file; ``spec`` is its parsed JSON."""

    def __init__(self, spec: dict):
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.tokens = dict((i, t) for t, i in vocab.items())
        self.tokens |= {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int64)
        pairs = [(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys = np.append(key[order], NONE)
        self.ranks = np.append(order.astype(np.int64), NONE)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split)
        self.cut = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.cache: dict[str, bytes] = dict(self.special)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, NONE where it doesn't merge."""
        pair = left << 32 | right
        at = np.searchsorted(self.keys, pair)
        return np.where(self.keys[at] == pair, self.ranks[at], NONE)

    def merge_rows(self, raw: list[bytes], width: int) -> list[bytes]:
        """Ids (little-endian, 32 bits) of words of at most ``width`` bytes, a power of two."""
        rows, n = len(raw), width
        size = np.fromiter(map(len, raw), np.int64, rows)
        data = np.frombuffer(b"".join(w.ljust(n, b"\0") for w in raw), np.uint8).reshape(rows, n)
        col = np.arange(n)
        ids = np.zeros((rows, n + 1), np.int64)
        ids[:, :n] = np.where(col == size[:, None] - 1, self.final[data], self.inner[data])
        after = np.broadcast_to(np.arange(1, n + 2), (rows, n + 1)).copy()
        after[:, :n][col[None, :] >= size[:, None] - 1] = n
        before = np.broadcast_to(np.arange(-1, n), (rows, n + 1)).copy()
        kept = col[None, :] < size[:, None]
        tree = np.full((rows, 2 * n), NONE)
        if n > 1:
            first = self.rank(ids[:, :n - 1], ids[:, 1:n])
            first[col[None, 1:] >= size[:, None]] = NONE
            tree[:, n:2 * n - 1] = np.where(first < NONE, first * n + col[:n - 1], NONE)
        level = n
        while level > 1:
            level //= 2
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
        live = np.arange(rows)
        while len(live):
            root = tree[live, 1] if n > 1 else np.full(len(live), NONE)
            live, root = live[root < NONE], root[root < NONE]
            if not len(live):
                break
            pos, rank = root % n, root // n
            gone = after[live, pos]
            new = self.merged[rank]
            ids[live, pos] = new
            kept[live, gone] = False
            right = after[live, gone]
            after[live, pos] = right
            before[live, right] = pos
            left = before[live, pos]
            tree[live, n + gone] = NONE
            r = np.where(right < n, self.rank(new, ids[live, right]), NONE)
            tree[live, n + pos] = np.where(r < NONE, r * n + pos, NONE)
            has_left = np.flatnonzero(left >= 0)
            at, l = live[has_left], left[has_left]
            r = self.rank(ids[at, l], new[has_left])
            tree[at, n + l] = np.where(r < NONE, r * n + l, NONE)
            for who, leaf in ((live, gone), (live, pos), (at, l)):
                node = (n + leaf) >> 1
                while node.size and node[0]:
                    tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])
                    node = node >> 1
        flat = ids[:, :n][kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def learn(self, words: set[str]) -> None:
        """Put the ids of new words into the cache."""
        by_width: dict[int, list[str]] = {}
        for w in words:
            by_width.setdefault(1 << max(0, len(w.encode()) - 1).bit_length(), []).append(w)
        for width, ws in by_width.items():
            step = max(1, TREE_CELLS // (2 * width))
            for lo in range(0, len(ws), step):
                part = ws[lo:lo + step]
                self.cache.update(zip(part, self.merge_rows([w.encode() for w in part], width)))

    def ids_of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Ids of lists of words; the new words of all of them are merged at once."""
        new = set().union(*texts).difference(self.cache)
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache = dict(self.special)
            new = set().union(*texts).difference(self.cache)
        self.learn(new)
        return [np.frombuffer(b"".join(map(self.cache.__getitem__, words)), "<u4") for words in texts]

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # no final form of sigma: letters are folded one by one
                text = text.replace("Σ", "σ")
        return text.lower()

    def words_of(self, text: str) -> Iterator[str]:
        """Words of a text; special tokens stand for themselves."""
        at = 0
        for m in self.cut.finditer(text) if "<|" in text else ():
            yield from self.words.findall(self.normal(text[at:m.start()]))
            yield m.group()
            at = m.end()
        yield from (m.group() for m in self.words.finditer(self.normal(text[at:])))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; unsigned 32 bit, little-endian."""
        out, lists = [], []
        for text in texts:
            if not text or len(text) <= PIECE_CHARS:
                plain = not text or "<|" not in text
                lists.append(self.words.findall(self.normal(text or "")) if plain else list(self.words_of(text)))
                continue
            words, parts = self.words_of(text), []
            while part := list(islice(words, PIECE_CHARS // 4)):
                parts += self.ids_of([part])
            out += [*self.ids_of(lists), np.concatenate(parts)] if parts else self.ids_of([*lists, []])
            lists = []
        return out + self.ids_of(lists)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


_LOADED: dict[str, SegmentTreeBpe] = {}


def load(text: str) -> SegmentTreeBpe:
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = SegmentTreeBpe(json.loads(text))
    return _LOADED[key]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Output columns that ``encode_texts`` can make of a text's ids.
_MAKES = {
    "n_tokens": ("long", pa.int64(), lambda bpe, ids: len(ids)),
    "ids": ("array<int>", pa.list_(pa.int32()), lambda bpe, ids: ids.astype(np.int32)),
    "decoded": ("string", pa.string(), lambda bpe, ids: bpe.decode(ids)),
    "ids_sha256": ("string", pa.string(), lambda bpe, ids: hashlib.sha256(ids.tobytes()).hexdigest()),
    "decoded_sha256": ("string", pa.string(), lambda bpe, ids: hashlib.sha256(bpe.decode(ids).encode()).hexdigest()),
}


def encode_texts(docs: DataFrame, keep: list[str], make: list[str], vocabulary: str | None = None) -> DataFrame:
    """Columns ``keep`` of every row and columns ``make`` (n_tokens, ids,
    decoded, ids_sha256, decoded_sha256) of its whole text. ``vocabulary`` is a
    path on the driver; its text is sent to the tasks."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(sent.value)
        for b in batches:
            rows = max(1, min(b.num_rows, PIECE_CHARS * b.num_rows // max(b.nbytes, 1)))
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                found = bpe.encode(part.column(len(keep)).to_pylist())
                made = [pa.array([_MAKES[m][2](bpe, ids) for ids in found], _MAKES[m][1]) for m in make]
                yield pa.record_batch([*part.columns[:len(keep)], *made],
                                      schema=pa.schema([*kept, *(pa.field(m, _MAKES[m][1]) for m in make)]))

    kept = [pa.field(c, to_arrow_type(docs.schema[c].dataType)) for c in keep]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep),
                        *(f"{m} {_MAKES[m][0]}" for m in make)])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, decoded) of rows (doc_id, ids)."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(sent.value)
        for b in batches:
            texts = [bpe.decode(np.array(ids or (), np.int64)) for ids in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded string")


def op6_bpe(docs: DataFrame) -> DataFrame:
    """Contract columns."""
    return encode_texts(docs, ["doc_id"], ["n_tokens", "ids_sha256", "decoded_sha256"])
