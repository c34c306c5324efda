"""URL filters: rules first, then a character language-model ratio.

Rules name a host, which also stands for its subdomains, and the start of a path; the longest that fits decides. The
other URLs are judged by two smoothed variable-order Markov models of characters, one of URLs that rules allow and one of
those that they block. A character's probability after a context of k characters is (n(context, character) + MASS * p of
the context one shorter) / (n(context) + MASS), down to equal probability, so unseen contexts fall back to shorter ones.
The score is the difference of the two log-likelihoods divided by the length; its threshold is the middle between the
classes' mean scores on every fifth labelled URL (by hash), which the models didn't see.

Counts are exact, by the 64-bit hash of a gram (contexts are made longer than any gram). They are gathered over all labelled rows in
bounded maps of each task, added up by shards of hashes and written as sorted arrays, a file a shard, to the shared
folder; tasks map these files. So the driver gathers only the numbers of the shards that have rows.

Defined cases: a null URL or one without "://" has empty host and path, fits no rule, and its verdict is that of the
text (null: empty) under the models; an empty text scores 0; where a class has no rows, or none is left for calibration,
the threshold is 0; equal scores allow; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, new_folder
from .eliasfano import read_arrays, write_arrays

#: (allow, host, path). Fixed values of the production filter.
RULES = ((True, "com", "/"), (False, "example.com", "/en/"), (True, "www.example.com", "/en/"), (False, "net", "/es/"), (False, "net", "/fr/"))
ORDER, MASS, ALPHABET = 5, 2.0, 256
#: After a context: no gram is as long, so that neither equals the other (short texts under two seeds do collide).
_CONTEXT = b"\x00" * (ORDER + 2)
#: URLs that are scored at a time.
AT_ONCE = 500
#: Entries of a task's counter before it is sent on.
HELD = 300_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url) -> F.Column:
    """After the first "://" up to /, ?, # or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url) -> F.Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host, path, rules=RULES) -> F.Column:
    """The longest rule that fits, as text, or null."""
    chain = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        chain = F.when(fits, h + p).otherwise(chain)
    return chain


def _hashes(data: bytes) -> list[int]:
    """Hashes of grams and of their contexts by turns: of all orders, for each the characters and the end of a text."""
    data = b"\x02" * ORDER + data + b"\x03"
    out = []
    for k in range(ORDER + 1):
        for i in range(ORDER, len(data)):
            out.append(xxhash.xxh3_64_intdigest(data[i - k : i + 1]))
            out.append(xxhash.xxh3_64_intdigest(data[i - k : i] + _CONTEXT))
    return out


def _count(shards: int):
    schema = pa.schema([("shard", pa.int32()), ("h", pa.int64()), ("blocked", pa.int64()), ("allowed", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            h = np.array(list(held[0].keys() | held[1].keys()), np.uint64)
            n = [[c[k] for k in h.tolist()] for c in held]
            return batches(schema, [h % np.uint64(shards), h.view(np.int64), *n])

        for batch in it:
            for allow, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[allow].update(_hashes(url.encode()))
                if len(held[0]) + len(held[1]) > HELD:
                    yield out()
                    held[0].clear()
                    held[1].clear()
        if held[0] or held[1]:
            yield out()

    return run


def _write(folder: str):
    """Sorted rows (shard, h, blocked, allowed) -> a file a shard, and its number."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def out() -> pa.RecordBatch:
            h, blocked, allowed = (np.concatenate(x) for x in zip(*parts, strict=True))
            write_arrays(f"{folder}/g{now:05d}", {"h": h, "blocked": blocked, "allowed": allowed})
            return batches(pa.schema([("shard", pa.int32())]), [[now]])

        for batch in it:
            shard, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            edges = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi == lo:
                    continue
                if parts and shard[lo] != now:
                    yield out()
                    parts = []
                now = int(shard[lo])
                parts.append([c[lo:hi] for c in columns])
        if parts:
            yield out()

    return run


class Counts:
    """Counts of both classes, as mapped files of all shards."""

    def __init__(self, folder: str, shards: int, present: list[int]):
        self.shards = shards
        self.files = {s: read_arrays(f"{folder}/g{s:05d}") for s in present}

    def find(self, h: np.ndarray) -> np.ndarray:
        """From hashes: the counts of [block, allow]; each different hash is looked up once."""
        h, back = np.unique(h, return_inverse=True)
        shard = (h % np.uint64(self.shards)).astype(np.int64)
        h, out = h.view(np.int64), np.zeros((2, len(h)))
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s, a in self.files.items():
            at = order[ends[s] : ends[s + 1]]
            if len(at):
                place = np.minimum(np.searchsorted(a["h"], h[at]), len(a["h"]) - 1)
                hit = a["h"][place] == h[at]
                out[0, at[hit]], out[1, at[hit]] = a["blocked"][place[hit]], a["allowed"][place[hit]]
        return out[:, back]


_cache: dict = {}


def _counts(folder: str, shards: int, present: list[int]) -> Counts:
    """One set of mapped files a Python worker."""
    if _cache.get("key") != folder:
        _cache.clear()
        _cache.update(key=folder, counts=Counts(folder, shards, present))
    return _cache["counts"]


def log_likelihood(n: np.ndarray) -> np.ndarray:
    """From counts (order, character, [gram, context]): the log probability of each character."""
    p = np.full(n.shape[1], 1.0 / ALPHABET)
    for k in range(n.shape[0]):
        p = (n[k, :, 0] + MASS * p) / (n[k, :, 1] + MASS)
    return np.log(p)


def scores(datas: list[bytes], counts: Counts) -> list[float]:
    """Length-normalised log-likelihood differences; above 0 rather like allowed URLs."""
    out: list[float] = []
    for first in range(0, len(datas), AT_ONCE):
        some = datas[first : first + AT_ONCE]
        h = np.concatenate([np.array(_hashes(d), np.uint64).reshape(ORDER + 1, -1, 2) for d in some], axis=1)
        block, allow = counts.find(h.ravel()).reshape(2, *h.shape)
        size = np.array([len(d) + 1 for d in some])
        total = np.add.reduceat(log_likelihood(allow) - log_likelihood(block), np.r_[0, np.cumsum(size)[:-1]])
        out += [float(x) if d else 0.0 for x, d in zip(total / size, some, strict=True)]
    return out


def judge(pages: DataFrame, ident: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides) of every row."""
    spark = pages.sparkSession
    rows = pages.select(F.col(ident).cast("long").alias("page_id"), F.col(url).alias("u"))
    rows = rows.withColumn("host", host_of(F.col("u"))).withColumn("path", path_of(F.col("u")))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    allowed = F.col("rule").isin([h + p for a, h, p in rules if a])
    labelled = rows.where("rule is not null").select(allowed.alias("allow"), "u", (F.pmod(F.xxhash64("u"), F.lit(5)) == 0).alias("out"))
    shards, folder = int(spark.conf.get("spark.sql.shuffle.partitions")), new_folder(spark, "url-counts")
    counted = labelled.where("not out").select("allow", "u").mapInArrow(_count(shards), "shard int, h long, blocked long, allowed long")
    summed = counted.repartition(shards, "shard").groupBy("shard", "h").agg(F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"))
    present = [r["shard"] for r in summed.sortWithinPartitions("shard", "h").mapInArrow(_write(folder), "shard int").collect()]  # a row a shard
    scored = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("score", pa.float64())])
    held_out = pa.schema([("allow", pa.bool_()), ("n", pa.int64()), ("total", pa.float64())])

    def calibrate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = [0, 0], [0.0, 0.0]
        for batch in it:
            for a, x in zip(batch.column(0).to_pylist(), scores([u.encode() for u in batch.column(1).to_pylist()], _counts(folder, shards, present)), strict=True):
                n[a] += 1
                total[a] += x
        yield batches(held_out, [[False, True], n, total])

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            free = [r is None for r in batch.column(4).to_pylist()]
            found = iter(scores([(u or "").encode() for u, f in zip(batch.column(1).to_pylist(), free, strict=True) if f], _counts(folder, shards, present)))
            s = [next(found) if f else None for f in free]
            yield batches(scored, [batch.column(0), batch.column(2), batch.column(3), batch.column(4), s])

    means = {r["allow"]: r["mean"] for r in labelled.where("out").select("allow", "u").mapInArrow(calibrate, "allow boolean, n long, total double").groupBy("allow").agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("mean")).collect()}
    threshold = (means[True] + means[False]) / 2 if means.get(True) is not None and means.get(False) is not None else 0.0
    out = rows.select("page_id", "u", "host", "path", "rule").mapInArrow(apply, "page_id long, host string, path string, rule string, score double")
    verdict = F.when(F.col("rule").isin([h + p for a, h, p in rules if a]), "allow").when(F.col("rule").isNotNull(), "block").when(F.col("score") >= threshold, "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
