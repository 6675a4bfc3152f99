"""Joins with explicit first-match, completeness and multiset semantics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eager_load(parents: DataFrame, children: DataFrame, key: str, fk: str, child: Column, name: str) -> DataFrame:
    """Every parent with the sorted array of its children; childless parents have an empty one."""
    nested = children.groupBy(F.col(fk).alias(key)).agg(F.array_sort(F.collect_list(child)).alias(name))
    kind = nested.schema[name].dataType
    return parents.join(nested, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def first_match(left: DataFrame, right: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Left join to the first right row of a key by its ordinal; one aggregation instead of a sort by key."""
    fields = [c for c in right.columns if c != key]
    first = right.groupBy(key).agg(F.min_by(F.struct(*fields), F.col(ordinal)).alias("__first"))
    return left.join(first.select(key, *[F.col(f"__first.{c}").alias(c) for c in fields]), key, "left")


def require_all(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that fails if a left row has no match."""
    if not (gap := left.join(right, key, "left_anti")).isEmpty():
        raise ValueError(f"rows without a match on {key}: {[r[key] for r in gap.select(key).distinct().limit(5).collect()]}")
    return left.join(right, key)


#: A key that holds over one in HEAVY of all rows is joined by broadcast; there are fewer than HEAVY such keys.
HEAVY = 1000


def join_facts(rows: DataFrame, keys: list[str], name: str, fact: Column) -> DataFrame:
    """`rows` with `fact`, an aggregate of its key's rows, as `name`; null keys are keys like any other.

    Facts are combined on the map side. Keys with over a thousandth of all rows (fewer than a thousand
    of them) meet their fact by broadcast, so a key that a third of all rows share is no single task.
    """
    facts = rows.groupBy(*keys).agg(fact.alias(name), F.count(F.lit(1)).alias("__n"))
    facts = facts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], name, "__n")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    total = rows.count()
    heavy = F.broadcast(facts.where(F.col("__n") * HEAVY > total))
    light = facts.where(F.col("__n") * HEAVY <= total)
    out = rows.join(heavy, same).unionByName(rows.join(heavy, same, "left_anti").join(light, same))
    return out.drop("__n", *[f"__k{i}" for i in range(len(keys))])


#: Lengths of labels that are told apart at most; more are an error.
MAX_LENGTHS = 1000


def suffix_match(rows: DataFrame, column: str, labels: DataFrame, label: str, ordinal: str) -> DataFrame:
    """The first label (by ordinal) that a value ends with.

    Values are cut at the lengths that labels have and joined by equality, so no
    pair of a value and a label is looked at in vain.
    """
    found = labels.select(F.length(label)).where(F.col(label).isNotNull()).distinct().limit(MAX_LENGTHS + 1).collect()
    if len(found) > MAX_LENGTHS:
        raise ValueError(f"labels of more than {MAX_LENGTHS} lengths")
    if not found:
        return rows.join(labels.select(F.lit(None).cast(rows.schema[column].dataType).alias(column), label).limit(0), column, "left")
    lengths = sorted(r[0] for r in found)
    tails = F.array(*[F.right(F.col(column), F.lit(n)) for n in lengths])
    keys = rows.select(column).distinct().select(column, F.explode(F.array_distinct(tails)).alias(label))
    found = keys.join(labels, label).groupBy(column).agg(F.min_by(F.col(label), F.col(ordinal)).alias(label))
    return rows.join(found, column, "left")


def multiset_difference(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    """Per key how often it is missing from b and extra in b, duplicates counted."""
    x = a.groupBy(*key).agg(F.count(F.lit(1)).alias("n_a"))
    y = b.groupBy(*key).agg(F.count(F.lit(1)).alias("n_b"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = x.join(y, list(key), "full_outer")
    return both.select(*key, F.greatest(n("n_a") - n("n_b"), F.lit(0)).alias("missing"), F.greatest(n("n_b") - n("n_a"), F.lit(0)).alias("extra"))


def patch(rows: DataFrame, patches: DataFrame, key: str, column: str) -> DataFrame:
    """Replaces `column` where a patch exists; `patched` tells which rows."""
    p = patches.select(key, F.col(column).alias("__new"))
    joined = rows.join(p, key, "left")
    return joined.withColumn("patched", F.col("__new").isNotNull()).withColumn(column, F.coalesce("__new", column)).drop("__new")
