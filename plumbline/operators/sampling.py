"""Seeded stratified samples and the estimates made from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.prng import mulberry32
from .windows import running_total


def seeded_order(seed: int, key: Column) -> Column:
    """A sort key that is the same in every engine: md5 of seed:key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def stratified_sample(population: DataFrame, stratum: str, key: str, allocation: dict[str, int | None], size: int, seed: int) -> DataFrame:
    """Rows of the sample with population, sampled and weight of their stratum.

    A stratum gets its number (all, if it has fewer); strata at None share what is left of
    `size`, one after the other. A stratum without an allocation is an error. The rows of
    a stratum are ranked in parts first, so no stratum is one sort.
    """
    # One stratum more than planned is enough to tell; so no more come to the driver.
    counts = {r[0]: r[1] for r in population.groupBy(stratum).count().limit(len(allocation) + 1).collect()}
    if unplanned := set(counts) - set(allocation):
        raise ValueError(f"strata with no allocation: {sorted(map(str, unplanned))}")
    taken = {k: min(n, counts.get(k, 0)) for k, n in allocation.items() if n is not None}
    for k in (k for k, n in allocation.items() if n is None):
        taken[k] = min(max(0, size - sum(n for s, n in taken.items() if allocation[s] is not None)), counts.get(k, 0))
    rows = [(k, counts.get(k, 0), n, counts[k] / n) for k, n in taken.items() if n]
    plan = population.sparkSession.createDataFrame(rows, f"`{stratum}` string, population long, sampled long, weight double")
    h = seeded_order(seed, F.col(key))
    marked = population.withColumn("__h", h).join(F.broadcast(plan), stratum)
    part = F.pmod(F.xxhash64(key), F.lit(64))
    near = W.partitionBy(stratum, "__p").orderBy("__h", key)
    cut = marked.withColumn("__p", part).withColumn("__n", F.row_number().over(near)).filter("__n <= sampled")
    last = W.partitionBy(stratum).orderBy("__h", key)
    return cut.withColumn("pos", F.row_number().over(last)).filter("pos <= sampled").drop("__h", "__p", "__n")


def replayed_ranks(size: int, n: int, seed: int, block: int = 1 << 16) -> list[int]:
    """The ranks that an exact Fisher-Yates shuffle of `size` items puts first, n of them.

    The swaps are walked back from the last: only n places are followed, and the
    draws, whose generator counts, come in blocks from any point on.
    """
    n = min(n, size)
    slot_at = {p: p for p in range(n)}  # place -> position in the sample
    for low in range(1, size, block):
        i = np.arange(low, min(low + block, size))
        # The swap of i takes draw size - 1 - i, counted from 0.
        draws = mulberry32(seed + (size - 1 - int(i[-1])) * 0x6D2B79F5, len(i))[::-1]
        j = np.floor(draws * (i + 1)).astype(np.int64)
        at = 0
        while at < len(i):
            places = np.fromiter(slot_at, dtype=np.int64, count=len(slot_at))
            hits = np.flatnonzero(np.isin(j[at:], places) | np.isin(i[at:], places))
            if not len(hits):
                break
            at += int(hits[0])
            a, b = int(i[at]), int(j[at])
            if a != b:
                swapped = {b: slot_at.pop(a, None), a: slot_at.pop(b, None)}
                slot_at.update({place: position for place, position in swapped.items() if position is not None})
            at += 1
    out = [0] * n
    for place, position in slot_at.items():
        out[position] = place
    return out


def replayed_draw(items: list, n: int, seed: int) -> list:
    """The exact Fisher-Yates draw of an ordered list."""
    return [items[r] for r in replayed_ranks(len(items), n, seed)]


def replayed_sample(population: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The exact Fisher-Yates draw of a table in the order of `key` (unique, numeric), for replaying an older sample: its rows and `pos`.

    Only ranks are shuffled; rows get theirs by a running count over key ranges and meet the n drawn ranks by a join.
    """
    ranked = running_total(population.withColumn("__one", F.lit(1)), key, "__one", "__rank").drop("__one")
    drawn = population.sparkSession.createDataFrame(list(enumerate(replayed_ranks(population.count(), n, seed))), "pos int, __rank0 long")
    return ranked.join(F.broadcast(drawn), F.col("__rank") == F.col("__rank0") + 1).drop("__rank", "__rank0")


MERSENNE = 2**31 - 1


def drawn_positions(module: int, i: int, low: int, high: int, c: int) -> np.ndarray:
    """Positions in range(c) that draws low to high of resample i take: two squarings modulo 2^31 - 1, the same in every engine."""
    j = np.arange(low, high, dtype=np.uint64)
    p, bits = np.uint64(MERSENNE), np.uint64(31)
    part = np.empty_like(j)

    def fold(x: np.ndarray, times: int) -> None:
        # Keeps the remainder: 2^31 counts as 1. Twice brings any 64 bits below 2^31 + 4.
        for _ in range(times):
            np.right_shift(x, bits, out=part)
            np.bitwise_and(x, p, out=x)
            np.add(x, part, out=x)

    x = j * np.uint64(16807)
    x += np.uint64((i * 48271 + module * 69621 + 12345) % MERSENNE)
    fold(x, 2)
    np.multiply(x, x, out=x)
    fold(x, 2)
    x *= np.uint64(48271)
    x += np.uint64(i)
    fold(x, 2)
    np.multiply(x, x, out=x)
    fold(x, 2)
    x *= np.uint64(69621)
    x += j
    fold(x, 2)
    np.subtract(x, p, out=x, where=x >= p)
    np.floor_divide(x, np.uint64(c), out=part)
    part *= np.uint64(c)
    x -= part
    return x.view(np.int64)


#: Points that a task of a bootstrap holds; draws it makes, roughly, unless that takes more than MAX_BLOCKS tasks a module and chunk.
CHUNK_POINTS, TASK_DRAWS, MAX_BLOCKS = 1 << 22, 1 << 27, 32
#: Draws that are made at once: their arrays fit a core's cache.
SLICE_DRAWS = 1 << 15


def bootstrap_slopes(points: DataFrame, order: str, resamples: int, chunk: int = CHUNK_POINTS, draws: int = TASK_DRAWS, blocks: int = MAX_BLOCKS) -> DataFrame:
    """Regression slopes of resamples of each module's points (module, `order`, x, y): module, i, b.

    A resample has as many draws as the module has points; pairs with a null do not count, equal x give null.
    A module's resamples are dealt over up to `blocks` tasks, each of which has the module's points and makes its own draws, so
    only points are shuffled, and only sums come back. A module of over `chunk` points is cut: a task draws
    whole resamples but looks up the points of its chunk alone, which bounds its memory.
    """
    all_of = W.partitionBy("module")
    placed = points.where(F.col("module").isNotNull()).select(
        F.col("module").cast("bigint").alias("module"),
        (F.row_number().over(all_of.orderBy(order)) - 1).cast("bigint").alias("pos"),
        # Sums of what is left of the mean keep their digits.
        (F.col("x") - F.avg("x").over(all_of)).alias("x"),
        (F.col("y") - F.avg("y").over(all_of)).alias("y"),
        F.count(F.lit(1)).over(all_of).alias("c"),
    )
    n_blocks = F.least(F.lit(blocks), F.lit(resamples), F.ceil(F.col("c") * F.lit(resamples) / F.lit(draws)).cast("int"))
    dealt = placed.withColumn("chunk", F.floor(F.col("pos") / chunk)).withColumn("blocks", n_blocks).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def sums(key: tuple, table: pa.Table) -> pa.Table:
        module, at, block = (k.as_py() for k in key)
        c, step = table.column("c")[0].as_py(), table.column("blocks")[0].as_py()
        column = lambda name: table.column(name).to_numpy()  # noqa: E731  null is NaN
        pos = column("pos") - at * chunk
        x, y = np.empty(len(pos)), np.empty(len(pos))
        x[pos], y[pos] = column("x"), column("y")
        whole, known = len(pos) == c, ~(np.isnan(x) | np.isnan(y))
        all_known = bool(known.all())
        rows = []
        for i in range(block, resamples, step):
            n, sx, sy, sxx, sxy, low, high = 0, 0.0, 0.0, 0.0, 0.0, np.inf, -np.inf
            for begin in range(0, c, SLICE_DRAWS):
                p = drawn_positions(module, i, begin, min(begin + SLICE_DRAWS, c), c)
                if not whole:
                    p = p - at * chunk
                    p = p[(p >= 0) & (p < len(x))]
                if not all_known:
                    p = p[known[p]]
                if len(p):
                    a, b = x.take(p), y.take(p)
                    n, sx, sy, sxx, sxy = n + len(p), sx + a.sum(), sy + b.sum(), sxx + a @ a, sxy + a @ b
                    low, high = min(low, a.min()), max(high, a.max())
            rows.append((module, i, n, float(sx), float(sy), float(sxx), float(sxy), float(low), float(high)))
        names = ["module", "i", "n", "sx", "sy", "sxx", "sxy", "low", "high"]
        kinds = [pa.int64()] * 3 + [pa.float64()] * 6
        return pa.table([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    # Few groups of much work: a number keeps adaptive execution from merging their tasks.
    spark = points.sparkSession
    parts = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    keys = ["module", "chunk", "block"]
    found = dealt.repartition(parts, *keys).groupBy(*keys).applyInArrow(sums, "module bigint, i bigint, n bigint, sx double, sy double, sxx double, sxy double, low double, high double")
    added = found.groupBy("module", "i").agg(*[F.sum(s).alias(s) for s in ("n", "sx", "sy", "sxx", "sxy")], F.min("low").alias("low"), F.max("high").alias("high"))
    slope = (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"))
    return added.select("module", "i", F.when(F.col("high") > F.col("low"), slope).alias("b"))


def stratified_total(strata: DataFrame) -> DataFrame:
    """From (population, sampled, hits, unsure) per stratum: total, 95 % interval (floored at 0), and the bound that counts unsure as hits."""
    n, s = F.col("population").cast("double"), F.col("sampled").cast("double")
    p = F.when(s > 0, F.col("hits") / s).otherwise(0.0)
    u = F.when(s > 0, (F.col("hits") + F.col("unsure")) / s).otherwise(0.0)
    var = F.when(s > 0, n * n * p * (1 - p) / s * (1 - s / n)).otherwise(0.0)
    t = strata.agg(F.sum(n * p).alias("total"), F.sqrt(F.sum(var)).alias("se"), F.sum(n * u).alias("upper"))
    return t.select("total", F.greatest(F.lit(0.0), F.col("total") - 1.96 * F.col("se")).alias("low"), (F.col("total") + 1.96 * F.col("se")).alias("high"), "upper")


def ratio_estimate(strata: DataFrame) -> DataFrame:
    """From (population, sampled, kept, hits): estimated kept and hits, and precision = hits / kept."""
    w = F.try_divide(F.col("population").cast("double"), F.col("sampled"))
    k, t = F.sum(w * F.col("kept")), F.sum(w * F.col("hits"))
    return strata.agg(k.alias("kept"), t.alias("hits"), F.coalesce(F.try_divide(t, k), F.lit(0.0)).alias("precision"))


def precision_recall(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall, F1; 0 on empty denominators."""
    part = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    p, r = part(tp, tp + fp), part(tp, tp + fn)
    return p, r, part(2 * p * r, p + r)


def cohens_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement and kappa of two raters, from the contingency counts."""
    n = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    side_a, side_b = n.groupBy("a").agg(F.sum("n").alias("na")), n.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = side_a.join(side_b, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("x"))
    j = total.join(F.broadcast(chance))
    po, pe = F.col("same") / F.col("total"), F.col("x") / (F.col("total") * F.col("total"))
    return j.select(F.col("total").alias("n"), po.alias("agreement"), F.when(pe == 1, F.lit(1.0)).otherwise((po - pe) / (1 - pe)).alias("kappa"))
