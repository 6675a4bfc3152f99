"""Commit graphs: what a commit reaches, its first parents, and the last commit before a date.

A graph is a table of (graph, commit, parent, first): a row a parent, `first`
for the first one; commits without parents have none. Histories are long and
mostly straight, so nothing walks them a commit a round: straight runs are
halved by pointer doubling, and only what branches or merges is walked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import cut


def first_parents(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """(graph, commit, distance) of the chain of first parents from each head (graph, commit), the head at 0.

    Each round doubles the jump that every commit knows and the part of the chain
    that is found; a chain of a million commits takes twenty rounds.
    """
    jump = cut(edges.where("first").select("graph", "commit", F.col("parent").alias("to")), "jumps")
    found, step = cut(heads.select("graph", "commit", F.lit(0).cast("bigint").alias("distance")), "chain"), 1
    while True:
        more = cut(found.join(jump, ["graph", "commit"]).select("graph", F.col("to").alias("commit"), (F.col("distance") + step).alias("distance")), "chain")
        if more.isEmpty():
            return found
        found = cut(found.unionByName(more), "chain")
        on = jump.select("graph", F.col("commit").alias("to"), F.col("to").alias("further"))
        jump, step = cut(jump.join(on, ["graph", "to"]).select("graph", "commit", F.col("further").alias("to")), "jumps"), step * 2


def reachable(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """(graph, commit) of all that heads (graph, commit) reach, themselves included.

    A commit with one parent and one child, no head, lies within a run. Runs are
    contracted by doubling each one's way up to the commit that begins it; then the graph of begins
    is walked from the heads, a round a branch or merge on the longest way.
    """
    e = edges.select("graph", "commit", "parent").distinct()
    up = e.groupBy("graph", F.col("parent").alias("commit")).agg(F.count(F.lit(1)).alias("children"), F.min("commit").alias("child"))
    down = e.groupBy("graph", "commit").agg(F.count(F.lit(1)).alias("parents"))
    inner = up.join(down, ["graph", "commit"]).where("children = 1 AND parents = 1").join(heads.select("graph", "commit"), ["graph", "commit"], "left_anti")
    way = cut(inner.select("graph", "commit", F.col("child").alias("top")), "runs")
    while True:  # top: a commit further up the run, until it is the one that begins it
        on = way.select("graph", F.col("commit").alias("top"), F.col("top").alias("further"))
        if way.join(on, ["graph", "top"], "left_semi").isEmpty():
            break
        way = cut(way.join(on, ["graph", "top"], "left").select("graph", "commit", F.coalesce("further", "top").alias("top")), "runs")
    # An edge from within a run counts from the run's begin; edges into a run are taken by it.
    short = e.join(way, ["graph", "commit"], "left").select("graph", F.coalesce("top", "commit").alias("commit"), "parent")
    within = way.select("graph", F.col("commit").alias("parent"))
    short = cut(short.join(within, ["graph", "parent"], "left_anti").distinct(), "short")
    seen = frontier = cut(heads.select("graph", "commit").distinct(), "reached")
    while True:
        frontier = cut(frontier.join(short, ["graph", "commit"]).select("graph", F.col("parent").alias("commit")).distinct().join(seen, ["graph", "commit"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier), "reached")
    tops = seen.select("graph", F.col("commit").alias("top"))
    return seen.unionByName(way.join(tops, ["graph", "top"], "left_semi").select("graph", "commit"))


def last_before(chain: DataFrame, times: DataFrame, cutoff) -> DataFrame:
    """Of each graph the nearest commit of a chain of first parents that is no later than the cutoff (graph, commit, time, behind: later ones on the chain); none: no row."""
    timed = chain.join(times, ["graph", "commit"])
    passed = F.count_if(F.col("time") > cutoff)
    best = F.min_by(F.when(F.col("time") <= cutoff, F.struct("commit", "time")), F.when(F.col("time") <= cutoff, F.col("distance")))
    return timed.groupBy("graph").agg(best.alias("b"), passed.alias("behind")).where("b IS NOT NULL").select("graph", "b.commit", "b.time", "behind")
