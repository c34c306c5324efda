"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprint: A-Z are lower-cased, words joined by single blanks, and all 4-word shingles hashed by XXH64 (seed 42); a bit
is 1 if it is set in over half the hashes. Fingerprints link at ``most`` or fewer differing bits; the groups are the
connected components.

Index: fingerprints are sorted by their rank in Gray order, so that neighbours in the order share many bits anywhere in
the word. Eight neighbours make a node, eight nodes an upper node, and so on. A node keeps the mask of the bits that all
its fingerprints share and their pattern; bits that its parent shares already are left out. A search walks down from the
root, adds up differences under these masks, and drops a whole group once the sum exceeds the limit. Two further rules
keep large groups of near copies from becoming all pairs: a node whose fingerprints all carry the component of the query
is dropped, and the search goes one way, towards higher ranks.

Distribution: equal fingerprints are one row from the start. The 64 bits are cut into six blocks; at 4 differences two
blocks at least are equal, so each fingerprint goes to the 15 shards of its block pairs (hashed over the cluster), and
each shard holds an index of its own. A shard gives out a star: for each fingerprint that has a link there, one edge to
its component's first. So edges grow with fingerprints and never with pairs, and no link is lost. Components follow by
least labels and pointer jumping over written tables.

Defined cases: null, empty and blank texts have fingerprint zero, which links like any other; fewer than four words are
one shingle; a row's component follows from its text alone, so repeated rows share theirs, and rows of one identifier
(or of none) with different texts have each their own; a null identifier never names a component unless no other is
there; no rows give no rows; further columns are ignored by ``near_groups`` and kept by ``keep_one``, which leaves one
row of each component: that of the smallest identifier (null last), among those the smallest fingerprint, among those
the smallest SHA-256 of the text; rows that agree in all three are the same document, and any of them stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, byte_lists, join_hot, materialise
from .components import connected

SHINGLE, SEED, MOST = 4, 42, 4
#: Bits of the six blocks.
BLOCKS = (11, 11, 11, 11, 10, 10)
FANOUT = 8
#: Fingerprints of small shards that are searched together, and most (query, node) pairs held at once.
BATCH, FRONTIER = 200_000, 1 << 21
_HASHES = 1 << 16


def fingerprint(data: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text; long texts are hashed in pieces, so memory beyond the words is bounded."""
    words = data.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    span = min(size, len(words))
    hash64, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, _HASHES):
        h = np.array([hash64(joined[a : b - 1], seed) for a, b in zip(ends[i : min(n, i + _HASHES)], ends[i + span : min(n, i + _HASHES) + span], strict=True)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Where a code word stands in Gray order."""
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """The index over fingerprints that lie in separate shards (``runs``, ascending); links never cross shards."""

    def __init__(self, fps: np.ndarray, runs: np.ndarray):
        order = np.lexsort((gray_rank(fps), runs))
        self.fps, self.order = fps[order], order
        runs = runs[order]
        #: For each level, leaves first: where each node's children start and end, its last leaf, mask and pattern.
        self.levels: list[dict] = []
        both, some, run, last = self.fps, self.fps, runs, np.arange(len(fps))
        while True:
            firsts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
            at = np.arange(len(run)) - np.repeat(firsts, np.diff(np.r_[firsts, len(run)]))
            starts = np.flatnonzero(at % FANOUT == 0)
            ends = np.r_[starts[1:], len(run)]
            both, some = np.bitwise_and.reduceat(both, starts), np.bitwise_or.reduceat(some, starts)
            run, last = run[starts], last[ends - 1]
            self.levels.append({"start": starts, "end": ends, "last": last, "mask": both | ~some, "pattern": both})
            if len(run) == len(np.unique(run)):
                break
        self.root_of = np.searchsorted(run, runs)

    def components(self, most: int = MOST) -> np.ndarray:
        """For each fingerprint, in Gray order, the position of the first of its component."""
        n = len(self.fps)
        label = np.arange(n)
        step, at = 256, 0
        while at < n:
            q = np.arange(at, min(n, at + step))
            at, step = at + step, min(step * 2, 1 << 15)
            uniform = self._uniform(label)
            stack = [(len(self.levels) - 1, q, self.root_of[q], None)]
            while stack:
                level, query, node, spent = stack.pop()
                if len(query) > FRONTIER // FANOUT:
                    half = len(query) // 2
                    stack += [(level, query[s], node[s], None if spent is None else spent[s]) for s in (slice(half, None), slice(0, half))]
                    continue
                nodes = self.levels[level]
                if spent is None:
                    spent = np.bitwise_count((self.fps[query] ^ nodes["pattern"][node]) & nodes["mask"][node]).astype(np.int16)
                keep = (spent <= most) & (nodes["last"][node] > query) & (uniform[level][node] != label[query])
                query, node, spent = query[keep], node[keep], spent[keep]
                if not len(query):
                    continue
                width = nodes["end"][node] - nodes["start"][node]
                q2, shared, spent2 = np.repeat(query, width), np.repeat(nodes["mask"][node], width), np.repeat(spent, width)
                child = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(nodes["start"][node], width)
                if level:
                    below = self.levels[level - 1]
                    spent2 = spent2 + np.bitwise_count((self.fps[q2] ^ below["pattern"][child]) & below["mask"][child] & ~shared).astype(np.int16)
                    stack.append((level - 1, q2, child, spent2))
                else:
                    spent2 = spent2 + np.bitwise_count((self.fps[q2] ^ self.fps[child]) & ~shared).astype(np.int16)
                    hit = (spent2 <= most) & (child > q2)
                    self._join(label, q2[hit], child[hit])
        return label

    def _uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level, the component that all leaves of a node have in common, or -1."""
        out, low, high = [], label, label
        for x in self.levels:
            low, high = np.minimum.reduceat(low, x["start"]), np.maximum.reduceat(high, x["start"])
            out.append(np.where(low == high, low, -1))
        return out

    @staticmethod
    def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            la, lb = label[a], label[b]
            differ = la != lb
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            if not len(a):
                return
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


_EDGE = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def _search(most: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def links(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch | None:
            which, key, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
            new = np.r_[True, (which[1:] != which[:-1]) | (key[1:] != key[:-1])]
            runs = np.cumsum(new)
            many = (np.bincount(runs) > 1)[runs]
            if not many.any():
                return None
            index = GrayIndex(fp[many].view(np.uint64), runs[many])
            label = index.components(most)
            has = label != np.arange(len(label))
            return batches(_EDGE, [index.fps[has].view(np.int64), index.fps[label[has]].view(np.int64)])

        size = 0
        for batch in it:
            part = tuple(batch.column(i).to_numpy() for i in range(3))
            held.append(part)
            size += len(part[0])
            if size < BATCH:
                continue
            which, key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            begun = np.flatnonzero((which != which[-1]) | (key != key[-1]))
            if not len(begun):  # one shard so far
                continue
            cut = begun[-1] + 1
            got = links([(which[:cut], key[:cut], fp[:cut])])
            if got is not None:
                yield got
            held, size = [(which[cut:], key[cut:], fp[cut:])], len(which) - cut
        if held:
            got = links(held)
            if got is not None:
                yield got

    return run


def edges(fps: DataFrame, most: int = MOST) -> DataFrame:
    """From different fingerprints (column fp, long): edges (src, dst) that connect what links, a star for each shard."""
    if most > len(BLOCKS) - 2:
        raise ValueError("more blocks are needed")
    at, masks = 0, []
    for bits in BLOCKS:
        masks.append(((1 << bits) - 1) << at)
        at += bits
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in (a | b for a, b in combinations(masks, 2))]
    shards = F.explode(F.array(*(F.struct(F.lit(i).cast("int").alias("which"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))).alias("s")
    dealt = fps.select("fp", shards).select("s.which", "s.key", "fp").repartition("which", "key").sortWithinPartitions("which", "key")
    return dealt.mapInArrow(_search(most), "src long, dst long").distinct()


_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = np.array([fingerprint(x) for x in byte_lists(batch, 1)], dtype=np.uint64)
            yield batches(_FP, [batch.column(0), found.view(np.int64)])

    return docs.select(F.col(ident).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, fp long")


def _named(rows: DataFrame, most: int) -> DataFrame:
    """fp, root (a fingerprint of the component), component_id, n_links for each different fingerprint of rows."""
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    found = connected(edges(distinct.select("fp"), most))
    rooted = materialise(distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), (F.count("*") - 1).alias("n_links"))
    return join_hot(rooted, least, "root").select("fp", "root", "component_id", "n_links")


def near_groups(docs: DataFrame, ident: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """doc_id, fingerprint, component_id, n_links (different fingerprints in the component besides its own) of every row."""
    rows = materialise(fingerprints(docs, ident, text), "simhash")
    named = materialise(_named(rows, most), "simhash-named")
    return join_hot(rows, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def keep_one(docs: DataFrame, ident: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """The rows of docs, with their columns, that stay: one of each component.

    A row is known by identifier, fingerprint and hash of its text. Fingerprints are computed once, beside these; the
    rows that stay are found on them alone, and whole rows are then taken by a semi-join."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("sha", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            datas = byte_lists(batch, 1)
            found = np.array([fingerprint(x) for x in datas], dtype=np.uint64)
            yield batches(schema, [batch.column(0), found.view(np.int64), [hashlib.sha256(x).hexdigest() for x in datas]])

    key, sha = F.col(ident).cast("long"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    rows = materialise(docs.select(key, F.col(text)).mapInArrow(run, "doc_id long, fp long, sha string"), "simhash")
    # one row a fingerprint first: combined before the shuffle, so a text with a third of all rows is one row a task
    best = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "sha")).alias("best"))
    rooted = best.join(materialise(_named(rows, most), "simhash-named"), "fp")
    stay = rooted.groupBy("root").agg(F.min(F.struct("best.late", "best.doc_id", "fp", "best.sha")).alias("s")).select(F.coalesce("s.doc_id", F.lit(0)).alias("__i"), F.col("s.late").alias("__l"), F.col("s.sha").alias("__s"))
    row = docs.select(F.struct("*").alias("row"), F.coalesce(key, F.lit(0)).alias("__i"), key.isNull().alias("__l"), sha.alias("__s"))
    # rows that agree in all three are one document: they meet in the join's own partitioning
    return row.join(stay, ["__i", "__l", "__s"], "left_semi").dropDuplicates(["__i", "__l", "__s"]).select("row.*")
