"""Near-duplicate documents by chosen-path set similarity join.

A document is its set of distinct word shingles; equal sets are one member. A
member carries minwise tokens: for each of several hash functions the token of
its set that hashes lowest. Every tree starts with one function and puts
members with the same chosen token into a node. Nodes of at most ``MEDIUM``
members are compared exhaustively; a larger node chooses ``BRANCHES`` pairs of
functions by its own hash and branches its members by their tokens, level by
level; members of similarity s meet in about ``BRANCHES`` * s^2 children, so
nodes of less similar members die out. ``TREES`` independent trees raise the recall: a pair of similarity 0.8
misses the first choice of all eight with probability 0.2^8 < 3e-6.

Large nodes of true copies would not shrink, so each level first compares every
member of a large node with ``LEADERS`` central members of it, which is linear,
and joins what is linked into components. A node whose members are all in one
component is done; one with at most ``CROSS`` pairs of different components a
member has few members outside its largest component, which meet all others.
Only the rest branch. If no branching makes a node smaller (``LEVELS``), its
members are compared in full.

Where members meet, each is there once, with its set: a node's members are dealt
to a task (a large node's in blocks, or pairs of blocks, of at most ``MEDIUM``),
pairs whose signatures agree (cut at four standard deviations below the
threshold) and that no link of the same task joins yet are confirmed on the full
sets, and only links leave the task. So neither pairs nor copies of sets travel,
and a group of n copies costs about n comparisons.

Defined cases: null and empty texts have no set and are linked with nothing;
texts with fewer words than a shingle have their whole sequence as one; rows
with a null doc_id take no part (component null, kept false); rows that repeat
an id get the component of their own text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlab.llm.common import mix64, null_safe, shingle_hashes, small_side, text_key, text_slices, word_hashes
from eventlab.llm.components import components
from eventlab.sources.files import stage

TREES = 8
#: Members of a node above which central members are compared first, and above which it branches.
SMALL = 64
MEDIUM = 4096
BRANCHES = 2
LEADERS = 4
CROSS = 64
LEVELS = 10
#: Minwise tokens kept in full (one for each tree), and bytes of further ones (for branching and weighing pairs).
TOKENS = TREES
BYTES = 256
#: Tokens that vote for the central members of a large node.
VOTERS = 24
#: Bytes of a shingle's hash in a full set, and of the sets that meet in a task.
WIDTH = 6
SET_BYTES = 32 << 20

_RNG = np.random.default_rng(3)
_XOR = _RNG.integers(0, 2**63, TOKENS + BYTES, dtype=np.uint64)
_ODD = _RNG.integers(0, 2**63, TOKENS + BYTES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted inside each row, and the rows' offsets."""
    words, rows = word_hashes(data, offsets)
    hashes, row = shingle_hashes(words, rows, width)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    if len(hashes):
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1]))
        hashes, row = hashes[new], row[new]
    return hashes, np.searchsorted(row, np.arange(len(offsets)))


def signatures(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens [rows, TOKENS] of 32 bits, bytes [rows, BYTES]) of rows with a set."""
    first = at[:-1]
    tokens = np.empty((len(first), TOKENS), np.uint32)
    small = np.empty((len(first), BYTES), np.uint8)
    for k in range(TOKENS + BYTES):
        least = np.minimum.reduceat((hashes ^ _XOR[k]) * _ODD[k], first)
        least = mix64(least)
        if k < TOKENS:
            tokens[:, k] = least.astype(np.uint32)
        else:
            small[:, k - TOKENS] = least.astype(np.uint8)
    return tokens, small


def _fixed(rows: np.ndarray) -> pa.Array:
    """Rows of equal length as binary values."""
    raw = np.ascontiguousarray(rows)
    n, size = len(raw), raw.nbytes // max(len(raw), 1)
    offsets = (np.arange(n + 1) * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])


def sketch_documents(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, tkey, n, sid, tokens, sig): hash of the text, size and hash of the
    set, signatures; sid and signatures are null without a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in text_slices(b.column(1)):
                hashes, at = shingle_sets(data, offsets, width)
                n = np.diff(at)
                some = np.flatnonzero(n)
                ids, keys = b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo)
                none = np.flatnonzero(n == 0)
                if len(none):
                    k = len(none)
                    yield pa.record_batch([ids.take(pa.array(none)), keys.take(pa.array(none)), pa.array(np.zeros(k, np.int64)), 
                                           pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], names=names)
                if len(some):
                    first = at[:-1][some]
                    tokens, small = signatures(hashes, np.append(first, len(hashes)))
                    total = np.add.reduceat(mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)), first)
                    sid = mix64(total + n[some].astype(np.uint64)).view(np.int64)
                    yield pa.record_batch([ids.take(pa.array(some)), keys.take(pa.array(some)), pa.array(n[some].astype(np.int64)), pa.array(sid),
                                           _fixed(tokens), _fixed(small)], names=names)

    names = ["doc_id", "tkey", "n", "sid", "tokens", "sig"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", text_key("text").alias("tkey"))
    return rows.mapInArrow(run, f"doc_id {kind}, tkey long, n long, sid long, tokens binary, sig binary")


def _least_agreement(threshold: float) -> int:
    """Signature bytes that a pair at the threshold shares but for four
    standard deviations."""
    return int(np.floor(BYTES * threshold - 4 * np.sqrt(BYTES * threshold * (1 - threshold))))


def _groups(batches: Iterator[pa.RecordBatch], read: Callable[[pa.RecordBatch], list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, cut where a key ends; the first column is the key."""
    held = None
    for b in batches:
        part = read(b) if held is None else [np.concatenate(p) for p in zip(held, read(b))]
        if not len(part[0]):
            continue
        cut = int(np.searchsorted(part[0], part[0][-1]))  # the last group may go on in the next batch
        if cut:
            yield [p[:cut] for p in part]
        held = [p[cut:] for p in part]
    if held is not None and len(held[0]):
        yield held


MEMBER = "key long, lead boolean, sid long, label long, n long, sig binary"


def _read_members(b: pa.RecordBatch) -> list[np.ndarray]:
    new = [b.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
    return [*new, np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint8).reshape(-1, BYTES)]


def _agree(x: np.ndarray, y: np.ndarray, label: np.ndarray, n: np.ndarray, sig: np.ndarray, threshold: float, least: int
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows x against rows y (which broadcast), the pairs of different labels
    whose sizes allow the threshold and whose signatures agree, and by how much."""
    fits = (label[x] != label[y]) & (np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]) - 1e-9)
    x, y = (np.broadcast_to(v, fits.shape)[fits] for v in (x, y))
    shared = (sig[x] == sig[y]).sum(1)
    ok = shared >= least
    return x[ok], y[ok], shared[ok]


def _meeting(members: DataFrame, threshold: float) -> DataFrame:
    """Of members (key, lead, sid, label, n, sig), those whose signature agrees with
    one of another label under the same key (where there are leads, with a lead).
    Without leads, members that agree directly or through others come under a key
    of their own, a hash of their ids: most of them meet in several trees, and the
    same company has the same key everywhere."""
    least = _least_agreement(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, lead, sid, label, n, sig in _groups(batches, _read_members):
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(first, len(key)))
            led = np.logical_or.reduceat(lead, first)
            keep, company = np.zeros(len(key), bool), key.copy()
            for at, m in zip(first[led], size[led]):
                for h in at + np.flatnonzero(lead[at:at + m]):
                    x, y, _ = _agree(np.array([h]), np.arange(at, at + m), label, n, sig, threshold, least)
                    keep[x] = keep[y] = True
            pairs = [np.zeros((2, 0), np.int64)]
            for m in np.unique(size[~led & (size > 1)]):
                rows = first[~led & (size == m)][:, None] + np.arange(m)
                for block in np.array_split(rows, max(1, len(rows) * m // 20_000)):
                    pairs += [np.stack(_agree(block[:, i:i + 1], block[:, i + 1:], label, n, sig, threshold, least)[:2]) for i in range(m - 1)]
            x, y = np.concatenate(pairs, 1)
            keep[x] = keep[y] = True
            least_row = np.arange(len(key))
            while len(x):
                near = np.minimum(least_row[x], least_row[y])
                if (near == least_row[x]).all() and (near == least_row[y]).all():
                    break
                np.minimum.at(least_row, x, near)
                np.minimum.at(least_row, y, near)
                least_row = least_row[least_row]
            met = np.unique(np.concatenate([x, y]))
            total = np.zeros(len(key), np.uint64)
            np.add.at(total, least_row[met], mix64(sid[met].view(np.uint64)))
            company[met] = mix64(total[least_row[met]]).view(np.int64)
            at = np.flatnonzero(keep)
            if len(at):
                yield pa.record_batch([pa.array(company[at]), pa.array(lead[at]), pa.array(sid[at]), pa.array(label[at]), pa.array(n[at]),
                                       _fixed(sig[at])], names=["key", "lead", "sid", "label", "n", "sig"])

    rows = members.select("key", "lead", "sid", "label", "n", "sig").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, MEMBER)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    both = np.sort(np.concatenate([x, y]))
    return int((both[1:] == both[:-1]).sum())


def _linked(members: DataFrame, threshold: float, percent: int) -> DataFrame:
    """(a, b): labels that links among members (as of ``_meeting``) with their full
    sets join, each with the least of its key. Pairs are tried in order of
    agreement, and only while their components differ, so a key joins what all its
    links would."""
    least = _least_agreement(threshold)

    def read(b: pa.RecordBatch) -> list[np.ndarray]:
        sets = np.empty(b.num_rows, object)
        for k, v in enumerate(b.column(6)):
            raw = np.zeros((len(v.as_buffer()) // WIDTH, 8), np.uint8)
            raw[:, :WIDTH] = np.frombuffer(v.as_buffer(), np.uint8).reshape(-1, WIDTH)
            sets[k] = raw.view(np.uint64).ravel()
        return [*_read_members(b), sets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, lead, sid, label, n, sig, sets in _groups(batches, read):
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            a, b = [], []
            for at, end in zip(first, np.append(first[1:], len(key))):
                rows = np.arange(at, end)
                heads = rows[lead[rows]] if lead[rows].any() else rows[:-1]
                found = [_agree(np.array([h]), rows if lead[rows].any() else rows[rows > h], label, n, sig, threshold, least) for h in heads]
                if not found:
                    continue
                x, y, shared = (np.concatenate(v) for v in zip(*found))
                parent = {v: v for v in label[rows].tolist()}

                def root(v: int) -> int:
                    while parent[v] != v:
                        parent[v] = v = parent[parent[v]]
                    return v

                for k in np.argsort(-shared, kind="stable"):
                    i, j = x[k], y[k]
                    p, q = root(label[i]), root(label[j])
                    if p != q:
                        both = _shared(sets[i], sets[j])
                        if 100 * both >= percent * (n[i] + n[j] - both):
                            parent[max(p, q)] = min(p, q)
                joined = [(root(v), v) for v in parent if root(v) != v]
                a += [r for r, _ in joined]
                b += [v for _, v in joined]
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    cols = ["key", "lead", "sid", "label", "n", "sig", "set"]
    return members.select(*cols).repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _in_full(nodes: DataFrame) -> DataFrame:
    """Keys under which all members of a node meet: the node itself, or the pairs of
    its blocks where members or sets are too many for one task."""
    blocks = F.greatest(F.ceil(F.col("size") / MEDIUM), F.ceil(F.col("total") * WIDTH / SET_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("sid"), F.col("_blocks")).cast("int")
    keys = F.when(F.col("_blocks") == 1, F.array("node")).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1), lambda j: F.xxhash64("node", F.least(j, F.col("_own")), F.greatest(j, F.col("_own")))))
    rows = nodes.withColumn("_blocks", blocks).withColumn("_own", own)
    return rows.select(F.explode(keys).alias("key"), F.lit(False).alias("lead"), "sid", "label", "n", "sig")


def _around(nodes: DataFrame, leads: DataFrame) -> DataFrame:
    """Keys under which all members of a node meet its leads (node, sid): blocks of
    the node, each with all leads."""
    blocks = F.greatest(F.ceil(F.col("size") / MEDIUM), F.ceil(F.col("total") * WIDTH / SET_BYTES)).cast("int")
    rows = nodes.withColumn("_blocks", blocks)
    heads = rows.join(leads.select("node", "sid"), ["node", "sid"]).withColumn("_own", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    others = rows.join(leads.select("node", "sid"), ["node", "sid"], "left_anti").withColumn("_own", F.pmod(F.xxhash64("sid"), F.col("_blocks")).cast("int"))
    both = heads.withColumn("lead", F.lit(True)).unionByName(others.withColumn("lead", F.lit(False)))
    return both.select(F.xxhash64("node", "_own").alias("key"), "lead", "sid", "label", "n", "sig")


def _leaders(large: DataFrame) -> DataFrame:
    """(node, sid): per node, the members that agree best with the most
    frequent token of each voter, one from each of ``LEADERS`` hashed parts. The
    tokens are counted inside every task first."""
    voter = lambda k: F.substring("sig", k + 1, 1)
    modes = large.groupBy("node").agg(*[F.mode(voter(k)).alias(f"mode_{k}") for k in range(VOTERS)])
    score = sum(((voter(k) == F.col(f"mode_{k}")).cast("int") for k in range(VOTERS)), F.lit(0))
    part = F.pmod(F.xxhash64("sid"), F.lit(LEADERS))
    return (large.select("node", "sid", "sig").join(modes, "node").groupBy("node", part.alias("part"))
            .agg(F.max(F.struct(score.alias("score"), F.col("sid")))["sid"].alias("sid")).select("node", "sid"))


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(sid, set) of the wanted members; ``wanted`` is (doc_id, sid)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in text_slices(b.column(1)):
                hashes, at = shingle_sets(data, offsets, width)
                raw = hashes.view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()
                sets = [raw[a * WIDTH:z * WIDTH] for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
                total = [int(mix64(hashes[a:z] ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                         for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
                sid = mix64(np.array(total, np.uint64) + np.diff(at).astype(np.uint64)).view(np.int64)
                yield pa.record_batch([pa.array(sid), pa.array(sets, pa.binary())], names=["sid", "set"])

    texts = docs.select("doc_id", "text").join(small_side(wanted.select("doc_id")), "doc_id", "left_semi")
    found = texts.select("doc_id", "text").mapInArrow(run, "sid long, set binary")
    # equal ids with other texts don't count
    return found.join(small_side(wanted.select("sid")), "sid", "left_semi").dropDuplicates(["sid"])


def _open_nodes(rows: DataFrame, labels: DataFrame | None, members: DataFrame) -> DataFrame:
    """(sid, node) of nodes with several components, with label, n, sig, the node's
    size, total of n, pairs of different components and largest component."""
    labelled = rows.withColumn("label", F.col("sid")) if labels is None else (
        rows.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid")))
    per = labelled.groupBy("node", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("w"))
    size = per.groupBy("node").agg(F.sum("k").alias("size"), F.sum("w").alias("total"), F.sum(F.col("k") * F.col("k")).alias("sq"),
                                   F.max(F.struct("k", "label"))["label"].alias("top"))
    several = size.where("size * size > sq").select("node", "size", "total", "top", ((F.col("size") * F.col("size") - F.col("sq")) / 2)
                                                    .alias("cross"))
    nodes = labelled.join(several, "node")
    return stage(nodes if "sig" in nodes.columns else nodes.join(members.select("sid", "sig"), "sid"), "near-open")


def link_components(docs: DataFrame, sketches: DataFrame, width: int, percent: int) -> DataFrame:
    """(sid, label): the linked sets and the least sid of their component."""
    threshold = percent / 100
    members = stage(sketches.where("sid is not null and doc_id is not null").groupBy("sid").agg(
        F.min(F.struct("doc_id", "n", "tokens", "sig")).alias("m")).select("sid", "m.*"), "near-members")
    token = lambda k: F.substring("tokens", 4 * k + 1, 4)
    rows = members.select("sid", "n", F.explode(F.array(*[F.xxhash64(F.lit(k), token(k)) for k in range(TREES)])).alias("node"))
    labels = sets = None

    def confirm(keyed: DataFrame, also: DataFrame | None = None) -> None:
        """Confirm what meets on full sets and join what is linked. The sets are
        made once, for those that meet first and all members of large nodes
        (``also``): later ones are among those."""
        nonlocal labels, sets
        met = stage(_meeting(keyed, threshold).dropDuplicates(["key", "sid"]), "near-met")
        if sets is None:
            wanted = met.select("sid") if also is None else met.select("sid").unionByName(also.select("sid"))
            wanted = stage(wanted.distinct().join(members.select("sid", "doc_id"), "sid"), "near-wanted")
            sets = stage(_sets(docs, wanted, width), "near-sets")
        new = _linked(met.join(sets, "sid"), threshold, percent)
        if labels is not None:
            new = new.unionByName(labels.select(F.col("label").alias("a"), F.col("sid").alias("b")))
        labels = components(new).withColumnRenamed("id", "sid")

    few = F.col("cross") <= CROSS * F.col("size")
    for level in range(LEVELS + 1):
        nodes = _open_nodes(rows, labels, members)
        large = nodes.where((F.col("size") > SMALL) & ~few)
        rest = nodes.where((F.col("size") <= SMALL) | few)
        several = not large.isEmpty()
        keyed = _in_full(rest.where(F.col("size") <= MEDIUM)).unionByName(
            _around(rest.where(F.col("size") > MEDIUM), rest.where((F.col("size") > MEDIUM) & (F.col("label") != F.col("top")))))
        if not several:
            confirm(keyed)
            break
        confirm(keyed.unionByName(_around(large, stage(_leaders(large), "near-leaders"))), large)
        # the same nodes again, now that their true copies are joined
        again = _open_nodes(large.select("sid", "n", "sig", "node"), labels, members)
        branching = again.where((F.col("size") > MEDIUM) & ~few)
        last = level == LEVELS or branching.isEmpty()
        spread = (F.col("size") > MEDIUM) & few
        full = again.where(~spread) if last else again.where(F.col("size") <= MEDIUM)
        confirm(_in_full(full).unionByName(_around(again.where(spread), again.where(spread & (F.col("label") != F.col("top"))))))
        if last:
            break
        # every level has functions of its own, so no choice repeats on a path
        half = BYTES // (2 * (LEVELS + 1))
        chosen = [[F.pmod(F.xxhash64("node", F.lit(2 * j + h)), F.lit(half)) + (2 * level + h) * half + 1 for h in (0, 1)]
                  for j in range(BRANCHES)]
        pick = lambda k: F.substring(F.col("sig"), k.cast("int"), F.lit(1))
        children = F.array(*[F.xxhash64("node", F.lit(j), pick(x), pick(y)) for j, (x, y) in enumerate(chosen)])
        rows = branching.select("sid", "n", "sig", F.explode(children).alias("node"))
    return labels


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, tkey, n_shingles, group) of every row; no group without a set."""
    sketches = stage(sketch_documents(docs, width), "near-sketches")
    labels = link_components(docs, sketches, width, percent)
    slim = sketches.select("doc_id", "tkey", F.col("n").alias("n_shingles"), "sid")
    return slim.join(labels, "sid", "left").withColumn("group", F.coalesce("label", "sid"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    marked = _grouped(docs, width, percent)
    first = marked.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    grouped = marked.where("group is not null").join(first, "group")
    alone = marked.where("group is null").withColumn("component_id", F.col("doc_id"))
    both = grouped.select("doc_id", "n_shingles", "component_id").unionByName(
        alone.select("doc_id", "n_shingles", "component_id"))
    known = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return both.select("doc_id", "n_shingles", known.alias("component_id"),
                       F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op3_near_dedup(docs: DataFrame) -> DataFrame:
    """Contract columns: shingles of four words."""
    return near_duplicates(docs, 4, 80)


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group stays, columns as given; rows with a null id
    stay. Texts that share an id are judged on their own; of rows that repeat an id
    and text one stays."""
    rows = _grouped(docs, width, percent).where("doc_id is not null").select("group", F.struct("doc_id", "tkey").alias("own"))
    first = rows.where("group is not null").groupBy("group").agg(F.min("own").alias("first"))
    rows = (rows.where("group is not null").join(first, "group").select("own", (F.col("own") == F.col("first")).alias("kept"))
            .unionByName(rows.where("group is null").select("own", F.lit(True).alias("kept"))))
    seen = rows.groupBy("own").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("times"))
    marked = stage(seen.where("not kept or times > 1"), "near-gone").select(
        "own.doc_id", F.col("own.tkey").alias("_near_tkey"), F.col("kept").alias("_near_kept"))
    keyed = docs.withColumn("_near_tkey", text_key("text"))
    joined = null_safe(keyed, marked, ["doc_id", "_near_tkey"], "left").where("_near_kept is null or _near_kept")
    alone = joined.where("_near_kept is null").select(*docs.columns)
    one = Window.partitionBy("doc_id", "_near_tkey").orderBy("_near_tkey")
    repeated = (joined.where("_near_kept").withColumn("_near_turn", F.row_number().over(one))
                .where("_near_turn = 1").select(*docs.columns))
    return alone.unionByName(repeated)
