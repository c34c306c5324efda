"""Mixing sources to target weights by a low-discrepancy schedule.

A document's size is its number of words. Sources in code-point order (null last) weigh 3, 1, 2, repeating; together
they share ``share`` of all words. A target stops at ``most`` times its source's size and the excess goes to the others
by weight: with sources in order of (cap / weight) those that stop are a prefix, so prefix sums give the one level that
the rest shares.

The mix is a row of slots of ``block`` words. Slot k has the golden-ratio point frac(k * phi), here the multiplicative
form (k * 2654435769) mod 2^32, which falls into one source's part of the cumulative targets; slots are ranked within
their source, and slot j of a source takes block j of that source's documents, laid end to end in shuffled order (by
md5 of the identifier) and once more from the start when they run out. Slots and blocks meet by (source, rank): what a
document is taken is what its blocks with a slot hold of it, and each copy's first slot gives the order in which ``mix``
returns it.

The last block of a source ends at its target, rounded to a word, so each source's taken words equal its target however
small it is. The points leave a source a few slots short of its blocks at times (their discrepancy grows with the
logarithm of their number; a source below a block may get none): the blocks left over get slots of their own, spread
evenly over the row. Slots beyond a source's last block stay empty. Reruns agree, and no document is taken more than
``most`` times.

Nothing is gathered by source alone: documents are put in order in (source, shuffle bucket) groups, slots are ranked in
(source, run of 4096 slots) groups, and only these sums meet by source. The points meet the sources' parts through an
equi-join on 4096 equal cells of the unit interval. Source totals, a row a source, are put in order in one task.

Defined cases: a null text has size 0; a null source is one source, the last; documents of size 0 take nothing; rows
that repeat identifier and source but not size lie in order of size, and rows that repeat all three are documents of
their own in ``plan``; a source of size 0 has target 0; no
rows give no rows; further columns are ignored by ``plan`` and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialise, texts

WEIGHTS = (3, 1, 2)
GOLDEN = 2654435769  # 2^32 / phi, odd
SPACE = 1 << 32
CELLS = 4096
RUN = 4096
BUCKET_CHARS = 3  # hex digits of the shuffle key: 4096 buckets a source
BLOCK_WORDS = 2048


def word_count(t) -> F.Column:
    return F.regexp_count(t, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """From one row (source, source_size) a source: target, and the parts [lo, hi) of 2^32 that slots map to."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("pos", F.row_number().over(by_name))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("pos") - 1) % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size"))
    upto = W.orderBy(F.col("cap") / F.col("weight"), "pos").rowsBetween(W.unboundedPreceding, -1)
    all_rows = W.orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("total", share * F.sum("source_size").over(all_rows))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(upto), F.lit(0)))
    s = s.withColumn("w_left", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    s = s.withColumn("level", F.col("left") / F.col("w_left"))
    s = s.withColumn("stops", F.col("cap") <= F.col("level") * F.col("weight"))
    first = F.min(F.when(~F.col("stops"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "pos", "level"))).over(all_rows)
    s = s.withColumn("target", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(first.getField("level") * F.col("weight")))
    cum = F.sum("target").over(by_name.rowsBetween(W.unboundedPreceding, 0))
    whole = F.sum("target").over(by_name.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    s = s.withColumn("hi", F.coalesce(F.floor(cum / F.nullif(whole, F.lit(0.0)) * SPACE), F.lit(0)).cast("long"))
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(by_name), F.lit(0)))
    return s.select("source", "pos", "weight", "source_size", "total", "target", "lo", "hi")


def _placed(parts: DataFrame, n_slots: int) -> DataFrame:
    """slot, pos: the source of each slot, through an equi-join on cells of the unit interval."""
    k = F.col("slot") % SPACE
    low, high = k % 65536, F.floor(k / 65536).cast("long")
    point = (low * GOLDEN + (high * GOLDEN % 65536) * 65536) % SPACE
    step = SPACE // CELLS
    slots = parts.sparkSession.range(n_slots).select(F.col("id").alias("slot")).withColumn("x", point).withColumn("cell", F.floor(F.col("x") / step).cast("int"))
    cells = parts.where("hi > lo").select("pos", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / step).cast("int"), F.floor((F.col("hi") - 1) / step).cast("int"))).alias("cell"))
    return slots.join(cells, "cell").where("x >= lo and x < hi").select("slot", "pos")


def schedule(parts: DataFrame, n_slots: int) -> DataFrame:
    """slot, pos, rank: which source each slot takes, and its rank among that source's slots."""
    put = _placed(parts, n_slots).withColumn("run", F.floor(F.col("slot") / RUN).cast("long"))
    runs = put.groupBy("pos", "run").agg(F.count("*").alias("n"))
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("pos").orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    put = put.withColumn("in_run", F.row_number().over(W.partitionBy("pos", "run").orderBy("slot")))
    return put.join(runs, ["pos", "run"]).select("slot", "pos", (F.col("before") + F.col("in_run") - 1).alias("rank"))


def plan(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, most: int = 2, block: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row, with its place in its source (at) and the first slot
    of each copy (slots; a slot of a block left over lies between whole slots)."""
    rows = texts(docs, text).select(F.col(f"row.{ident}").cast("long").alias("doc_id"), F.col(f"row.{source}").cast("string").alias("source"), word_count(F.col("t")).alias("size"))
    rows = materialise(rows.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))), "mix-sizes")
    parts = materialise(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, most), "mix-targets")
    total = parts.agg(F.max("total")).first()[0] or 0.0
    n_slots = int(-(-total // block))
    ends = parts.select("source", "pos", "source_size", "target")
    bucketed = rows.withColumn("bucket", F.substring("key", 1, BUCKET_CHARS))
    in_bucket = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = bucketed.withColumn("off", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("start", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.join(ends, sums["source"].eqNullSafe(ends["source"])).select(sums["source"].alias("s2"), F.col("bucket").alias("b2"), "pos", "start", "source_size", "target")
    laid = placed.join(sums, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2")))
    laid = laid.select("doc_id", "source", "size", "source_size", "target", "pos", (F.col("start") + F.col("off")).alias("at"), F.floor(F.col("target") + 0.5).cast("long").alias("stop"))
    laid = materialise(laid, "mix-laid")
    copies = laid.where("size > 0").select("pos", "at", "size", "stop", F.explode(F.array(*(F.struct(F.lit(e).alias("copy"), (F.col("at") + e * F.col("source_size")).alias("first")) for e in range(most)))).alias("c")).select("pos", "at", "size", "stop", "c.*")
    copies = copies.where("first < stop").withColumn("last", F.least(F.col("first") + F.col("size"), "stop"))
    blocks = copies.withColumn("rank", F.explode(F.expr(f"sequence(first div {block}, (last - 1) div {block})")))
    held = F.least(F.col("last"), (F.col("rank") + 1) * block) - F.greatest("first", F.col("rank") * block)
    put = materialise(schedule(parts, n_slots), "mix-slots")
    slots = put.select(F.col("slot").cast("double").alias("slot"), "pos", "rank").unionByName(_left_over(parts, put, n_slots, block))
    took = blocks.join(slots, ["pos", "rank"]).groupBy("pos", "at", "size", "copy").agg(F.sum(held).alias("n"), F.min("slot").alias("slot"))
    took = took.groupBy("pos", "at", "size").agg(F.sum("n").alias("taken"), F.array_sort(F.collect_list("slot")).alias("slots"))  # an entry a copy
    return laid.join(took, ["pos", "at", "size"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "at", "slots")


def _left_over(parts: DataFrame, put: DataFrame, n_slots: int, block: int) -> DataFrame:
    """slot, pos, rank of the blocks that the points give no slot: half a slot behind evenly spread ones."""
    got = put.groupBy("pos").agg(F.count("*").alias("got"))
    need = parts.where("target > 0").select("pos", F.ceil(F.floor(F.col("target") + 0.5) / block).cast("long").alias("need"))
    short = need.join(got, "pos", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    rank = short.select("pos", "need", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("rank"))
    return rank.select((F.floor((F.col("rank") + 0.5) / F.col("need") * n_slots) + 0.5).alias("slot"), "pos", "rank")


def mix(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, most: int = 2, block: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs as often as the mix takes them, with their columns: taken / size, rounded; whole texts,
    in the order of the first slots of the copies.

    A row is known by its identifier, source and size; rows that repeat these share what they are taken together, and the
    first place of each copy."""
    row = texts(docs, text).select("row", F.coalesce(F.col(f"row.{ident}").cast("string"), F.lit("")).alias("k"), F.coalesce(F.col(f"row.{source}").cast("string"), F.lit("")).alias("s"), F.col(f"row.{source}").isNull().alias("z"), word_count(F.col("t")).alias("n"))
    took = plan(docs, ident, text, source, share, most, block).groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k"), F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("z"), F.col("size").alias("n")).agg(F.sum("taken").alias("taken"), F.count("*").alias("rows"), F.array(*(F.min(F.when(F.size("slots") > e, F.struct(F.get("slots", F.lit(e)).alias("slot"), "at"))) for e in range(most))).alias("places"))
    times = F.floor(F.col("taken") / (F.col("n") * F.col("rows")) + 0.5).cast("int")
    return row.join(took.where("n > 0"), ["k", "s", "z", "n"]).withColumn("times", times).where("times > 0").select("row", "places", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).orderBy(F.element_at("places", F.col("copy"))).select("row.*")
