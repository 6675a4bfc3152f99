"""Mixing sources to target weights, in DataFrame functions only.

Targets are filled like water: every source gets its weight's share of the
budget up to a cap, and what capped sources leave is shared again. Within a
source, documents are ordered by Efraimidis-Spirakis keys -ln(u)/w (w is the
document's quality weight); a target above the source's size takes complete
epochs first, and the rest is taken along the key order until the prefix sum of
words meets the budget. The document on the border gives the words that are left.

Shape at scale: the texts are read once and only (id, source, size, key) goes
on, through a written table. The prefix sum of a source is not made in one task: keys fall
into about equal ranges of `BUCKET_ROWS` rows, whose totals are summed first
(a table of rows / BUCKET_ROWS), then each range is summed alone from its
offset. A source with a third of all rows is as many tasks as it needs. Rows of
one id, source, size and key are the same to the mix, so they fold into one row
with their number of copies, on the map side, and are dealt out again after the
sums: a key that a third of all rows share (null ids, say) is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Rows of one key range of a source, about.
BUCKET_ROWS = 2_000
#: Targets are broadcast up to this counted number of sources (about 60 bytes each); beyond it the join shuffles.
BROADCAST_SOURCES = 100_000
#: Characters that prose has few of; their share lowers a document's weight.
ODD = r"[!#$%&*|<>{}\[\]\\^~@=+_/0-9]"
MIN_WEIGHT = 0.05
#: Rows that one task deals out, about, where copies are many.
ROWS_PER_TASK = 200_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def quality_weight(text: Column) -> Column:
    """0.05 to 1: the fourth power of the share of characters that are not odd. Null and empty: 0.05."""
    plain = (F.length(text) - F.regexp_count(text, F.lit(ODD))) / F.length(text)
    return F.greatest(F.lit(MIN_WEIGHT), F.when(F.length(text) > 0, F.pow(plain, F.lit(4.0))).otherwise(F.lit(MIN_WEIGHT)))


def uniform(id_col: Column, size: Column) -> Column:
    """In (0, 1), from md5 of the id and the size; the same on every run and in other engines."""
    text = F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(":"), size.cast("string"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16**13))


def cycle_weights(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Sources by code point, null last, weigh `weights`, repeating. One row a source: a small table."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(order) - 1) % len(weights)
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at + 1))


def fill_targets(sizes: DataFrame, share: float, cap: float) -> DataFrame:
    """`sizes` (source, source_size, weight) -> adds target: share of all words by weight, at most cap times the source's size.

    Sorted by the level at which each source meets its cap, the sources before
    the first that stays below its level are capped; the others get the level times their weight.
    """
    s = sizes.withColumn("__cap", F.col("source_size") * cap).withColumn("__level", F.col("__cap") / F.col("weight"))
    order = W.orderBy("__level", F.col("source").asc_nulls_last())
    past = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    s = (
        s.withColumn("__budget", F.sum("source_size").over(everything) * share)
        .withColumn("__capped", F.coalesce(F.sum("__cap").over(past), F.lit(0.0)))
        .withColumn("__open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(past), F.lit(0.0)))
        .withColumn("__fill", (F.col("__budget") - F.col("__capped")) / F.col("__open"))
        .withColumn("__free", F.col("__fill") < F.col("__level"))
        .withColumn("__final", F.min(F.when(F.col("__free"), F.struct("__level", "__fill"))).over(everything)["__fill"])
    )
    target = F.when(F.col("__final").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__final") * F.col("weight")))
    return s.select(*sizes.columns, target.alias("target")).drop("weight")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    cap: float = 2.0,
    id_col: str = "doc_id",
    source_col: str = "source",
    text: str = "text",
    quality: Column | None = None,
) -> DataFrame:
    """Per row: id, source, size, source_size, target (of its source), taken, epochs (complete ones), es_key.

    `quality` is a column expression, a weight over 0. Null texts have size 0; a
    null source is a source of its own, last in order. Ties of the key go by id, null ids
    first; repeated rows are rows of their own and interchangeable. Sources without words have target 0. An empty
    table gives an empty result. Other columns are not read.
    """
    t = F.col(f"`{text}`")
    raw = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), word_count(t).alias("size"), (quality_weight(t) if quality is None else quality).alias("w")
    )
    # A key without nulls, so that the window and the join share one partitioning.
    raw = raw.withColumn("skey", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    keyed = raw.withColumn("es_key", -F.ln(uniform(F.col("id"), F.col("size"))) / F.col("w"))
    own = written(keyed.groupBy("skey", "source", "id", "size", "es_key").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    totals = own.groupBy("skey", "source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("source_size"),
        F.count(F.lit(1)).alias("n"),
        F.avg("es_key").alias("mean"),
        F.sum("copies").alias("n_rows"),
        F.max("copies").alias("most"),
    )
    plan = written(fill_targets(cycle_weights(totals, weights), share, cap), "targets").drop("source")
    facts = plan.agg(F.count(F.lit(1)).alias("sources"), F.sum("n_rows").alias("rows"), F.max("most").alias("most")).first()
    plan = plan.drop("n_rows", "most")
    if facts["sources"] <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    # Many copies are cut into parts, so that the copies of a part are few enough for one array.
    many = (facts["most"] or 0) > BUCKET_ROWS
    own = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / BUCKET_ROWS).cast("int"))) if many else F.lit(0))
    own = own.withColumn("copies", F.least(F.lit(BUCKET_ROWS).cast("bigint"), F.col("copies") - F.col("part").cast("bigint") * BUCKET_ROWS))
    # Exponential keys made about uniform; any monotone cut gives the same sums.
    keyed = own.join(plan, "skey").withColumn(
        "bucket", F.floor(F.ceil(F.col("n") / BUCKET_ROWS) * (1 - F.exp(-F.col("es_key") / F.greatest(F.col("mean"), F.lit(1e-12)))))
    )
    words = F.sum(F.col("size") * F.col("copies"))
    before = W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("skey", "bucket")
        .agg(words.alias("words"))
        .select("skey", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    )
    inside = W.partitionBy("skey", "bucket").orderBy("es_key", F.col("id").asc_nulls_first(), "size", "part").rowsBetween(W.unboundedPreceding, -1)
    summed = keyed.withColumn("__own", F.coalesce(words.over(inside), F.lit(0))).join(offsets, ["skey", "bucket"])
    if many:
        summed = summed.repartition(max(1, facts["rows"] // ROWS_PER_TASK), "skey", "id", "size", "es_key", "part")
    summed = summed.withColumn("__copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    summed = summed.withColumn("__own", F.col("__own") + F.col("__copy") * F.col("size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = F.col("target") - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.floor(rest).cast("bigint") - F.col("offset") - F.col("__own")))
    return summed.select(
        "id", "source", "size", "source_size", "target", (epochs * F.col("size") + part).cast("bigint").alias("taken"), epochs.alias("epochs"), "es_key"
    )
