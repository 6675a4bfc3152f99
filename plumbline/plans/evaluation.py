"""Sampling, estimation, scoring and round-to-round diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.prng import mulberry_sql
from ..functions.rules import percent
from ..operators.joins import multiset_difference
from ..operators.sampling import cohens_kappa, precision_recall, ratio_estimate, replayed_sample, seeded_order, stratified_sample, stratified_total
from ..sources.tables import Tables
from .registry import query

C = F.col
ALLOCATION: dict[str, int | None] = {"1-URGENT": 40, "2-HIGH": 40, "3-MEDIUM": 20, "4-NOT SPECIFIED": 10**9, "5-LOW": None}


@query("SELECT o_orderkey FROM orders ORDER BY md5('20261010:' || o_orderkey::VARCHAR), o_orderkey LIMIT 50")
def smp_01_seeded_sample(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").orderBy(seeded_order(20261010, C("o_orderkey")), "o_orderkey").limit(50)


REPLAY = f"""WITH RECURSIVE d AS ({mulberry_sql('42', 'SELECT unnest(range(1, 25)) AS n', 'n', 'n')}),
r(i, l) AS (
  SELECT 24::BIGINT, list(n_name ORDER BY n_name) FROM nation
  UNION ALL
  SELECT r.i - 1, list_transform(r.l, lambda x, k: CASE WHEN k - 1 = r.i THEN r.l[floor(d.draw * (r.i + 1))::BIGINT + 1] WHEN k - 1 = floor(d.draw * (r.i + 1))::BIGINT THEN r.l[r.i + 1] ELSE x END)
  FROM r JOIN d ON d.n = 25 - r.i WHERE r.i > 0
)
SELECT unnest(range(0, 10)) AS pos, unnest(l[1:10]) AS n_name FROM r WHERE i = 0"""


@query(REPLAY)
def smp_01_exact_replay(t: Tables) -> DataFrame:
    """The exact shuffle of an ordered table (here the 25 nations by name)."""
    return replayed_sample(t.nation.select(F.row_number().over(W.orderBy("n_name")).alias("k"), "n_name"), "k", 10, 42).select("pos", "n_name")


def drawn_sql(n: int, seed: int) -> str:
    """The first n of a shuffle of all orders, by walking the swaps back: for each place the swaps that move it, one after the other."""
    return f"""WITH RECURSIVE o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rank FROM orders), size AS (SELECT count(*) AS n FROM orders),
      i AS (SELECT unnest(range(1, (SELECT n FROM size))) AS i), d AS ({mulberry_sql(str(seed), 'SELECT i, (SELECT n FROM size) - i AS k FROM i', 'i', 'k')}),
      swaps AS (SELECT i, floor(draw * (i + 1))::BIGINT AS j FROM d),
      moves AS (SELECT j AS place, i AS step, i AS goes FROM swaps WHERE i <> j UNION ALL SELECT i, i, j FROM swaps WHERE i <> j),
      r(pos, place, step) AS (
        SELECT p, p, 0::BIGINT FROM (SELECT unnest(range(0, {n})) AS p)
        UNION ALL
        SELECT pos, goes, s FROM (SELECT r.pos, m.goes, m.step AS s, row_number() OVER (PARTITION BY r.pos ORDER BY m.step) AS k FROM r JOIN moves m ON m.place = r.place AND m.step > r.step) WHERE k = 1
      ), last AS (SELECT pos, arg_max(place, step) AS place FROM r GROUP BY pos)
      SELECT pos::INT AS pos, o_orderkey FROM last JOIN o ON rank = place"""


@query(drawn_sql(40, 7))
def smp_01_replayed_orders(t: Tables) -> DataFrame:
    """Forty orders of an exact shuffle of all; nothing but ranks is drawn in the driver."""
    return replayed_sample(t.orders.select("o_orderkey"), "o_orderkey", 40, 7).select("pos", "o_orderkey")


STRATA = {"F": 30, "O": 30, "P": None}


def sample(t: Tables) -> DataFrame:
    return stratified_sample(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderstatus", "o_orderkey", STRATA, 100, 7)


@query(
    """SELECT o_orderkey, o_orderstatus, population::BIGINT AS population, least(alloc, population)::BIGINT AS sampled, population * 1.0::DOUBLE / least(alloc, population) AS weight FROM (
      SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('7:' || o_orderkey::VARCHAR), o_orderkey) AS pos, count(*) OVER (PARTITION BY o_orderstatus) AS population,
        CASE o_orderstatus WHEN 'P' THEN 40 ELSE 30 END AS alloc FROM orders) WHERE pos <= alloc"""
)
def smp_02_stratified(t: Tables) -> DataFrame:
    return sample(t).select("o_orderkey", "o_orderstatus", "population", "sampled", "weight")


@query("SELECT min(doc_id) AS loc, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS samples FROM documents GROUP BY md5(text)")
def smp_03_one_label_per_location(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.md5("text").alias("k"))
    ids = F.array_sort(F.collect_list("doc_id"))
    return d.groupBy("k").agg(F.min("doc_id").alias("loc"), ids.alias("s")).select("loc", F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("samples"))


@query("SELECT DISTINCT user_id, user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100) AS also FROM events")
def smp_04_membership_flags(t: Tables) -> DataFrame:
    other = t.events.filter("event_type = 'signup' AND value > 100").select("user_id").distinct().withColumn("also", F.lit(True))
    return t.events.select("user_id").distinct().join(other, "user_id", "left").withColumn("also", F.coalesce("also", F.lit(False)))


SAMPLED = """SELECT *, CASE o_orderstatus WHEN 'P' THEN 40 ELSE 30 END AS alloc, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('7:' || o_orderkey::VARCHAR), o_orderkey) AS pos,
  count(*) OVER (PARTITION BY o_orderstatus) AS population FROM orders"""
STRATUM_SQL = f"""SELECT o_orderstatus, max(population)::DOUBLE AS n, count(*)::DOUBLE AS s, count(*) FILTER (WHERE o_totalprice > 300000)::DOUBLE AS hits,
  count(*) FILTER (WHERE o_totalprice BETWEEN 280000 AND 300000)::DOUBLE AS unsure, count(*) FILTER (WHERE o_totalprice > 100000)::DOUBLE AS kept FROM ({SAMPLED}) WHERE pos <= alloc GROUP BY 1"""


def strata(t: Tables) -> DataFrame:
    price = C("o_totalprice")
    return sample(t).groupBy("o_orderstatus").agg(
        F.max("population").alias("population"), F.count(F.lit(1)).alias("sampled"), F.count_if(price > 300000).alias("hits"),
        F.count_if(price.between(280000, 300000)).alias("unsure"), F.count_if(price > 100000).alias("kept"),
    )


@query(
    f"""SELECT round(total, 6) AS total, round(greatest(0, total - 1.96 * se), 6) AS low, round(total + 1.96 * se, 6) AS high, round(upper, 6) AS upper FROM (
      SELECT sum(n * hits / s) AS total, sqrt(sum(n * n * (hits / s) * (1 - hits / s) / s * (1 - s / n))) AS se, sum(n * (hits + unsure) / s) AS upper FROM ({STRATUM_SQL}))"""
)
def est_01_stratified_total(t: Tables) -> DataFrame:
    return stratified_total(strata(t)).select(*[F.round(c, 6).alias(c) for c in ("total", "low", "high", "upper")])


@query(f"SELECT o_orderstatus, round(hits / s, 9) AS agreement FROM ({STRATUM_SQL})")
def est_02_agreement_rate(t: Tables) -> DataFrame:
    return strata(t).select("o_orderstatus", F.round(C("hits") / C("sampled"), 9).alias("agreement"))


@query(f"SELECT round(k, 6) AS kept, round(h, 6) AS hits, round(h / k, 9) AS precision FROM (SELECT sum(n / s * kept) AS k, sum(n / s * hits) AS h FROM ({STRATUM_SQL}))")
def est_03_ratio(t: Tables) -> DataFrame:
    return ratio_estimate(strata(t)).select(F.round("kept", 6).alias("kept"), F.round("hits", 6).alias("hits"), F.round("precision", 9).alias("precision"))


@query(
    f"""SELECT round(sum(now.n * hits / s), 6) AS total FROM (SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 50000 GROUP BY 1) now LEFT JOIN ({STRATUM_SQL}) r ON now.o_orderstatus = r.o_orderstatus"""
)
def est_04_post_stratified(t: Tables) -> DataFrame:
    """A later round's counts under the labelled rates; strata without labels contribute nothing."""
    now = t.orders.filter("o_totalprice > 50000").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    j = now.join(strata(t), "o_orderstatus", "left")
    return j.agg(F.round(F.sum(C("n") * F.try_divide(C("hits").cast("double"), C("sampled"))), 6).alias("total"))


@query(f"SELECT o_orderpriority, round(sum(population * 1.0::DOUBLE / alloc) FILTER (WHERE o_totalprice > 300000) / sum(population * 1.0::DOUBLE / alloc), 9) AS rate FROM ({SAMPLED}) WHERE pos <= alloc GROUP BY 1")
def est_05_weighted_rate(t: Tables) -> DataFrame:
    s = sample(t).join(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey")
    return s.groupBy("o_orderpriority").agg(F.round(F.sum(F.when(C("o_totalprice") > 300000, C("weight"))) / F.sum("weight"), 9).alias("rate"))


JUDGED = "SELECT l.doc_id, d.source, l.quality, CASE WHEN regexp_matches(d.text, '[|#%$!]{2}| [|] ') THEN 0 ELSE 1 END AS predicted, l.toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def judged(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", F.when(C("text").rlike(r"[|#%$!]{2}| [|] "), 0).otherwise(1).alias("predicted"))
    return t.labels.select("doc_id", "quality", "toxic").join(d, "doc_id")


def counts() -> list:
    q, p = C("quality") == 1, C("predicted") == 1
    return [F.count_if(q & p).alias("tp"), F.count_if(~q & p).alias("fp"), F.count_if(q & ~p).alias("fn")]


TPFP = "count(*) FILTER (WHERE quality = 1 AND predicted = 1)::BIGINT AS tp, count(*) FILTER (WHERE quality <> 1 AND predicted = 1)::BIGINT AS fp, count(*) FILTER (WHERE quality = 1 AND predicted <> 1)::BIGINT AS fn"


@query(
    f"""SELECT tp, fp, fn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM (
      SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp * 1.0::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp * 1.0::DOUBLE / (tp + fn) END AS r FROM (SELECT {TPFP} FROM ({JUDGED})))"""
)
def evl_01_precision_recall(t: Tables) -> DataFrame:
    p, r, f1 = precision_recall(C("tp"), C("fp"), C("fn"))
    return judged(t).agg(*counts()).select("tp", "fp", "fn", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(f1, 9).alias("f1"))


@query(
    f"""SELECT coalesce(source, 'total') AS source, tp, fp, CASE WHEN tp + fp = 0 THEN 0 ELSE floor(fp * 1000.0::DOUBLE / (tp + fp) + 0.5) / 10 END AS fp_rate, CASE WHEN tp + fn = 0 THEN 0 ELSE floor(tp * 1000.0::DOUBLE / (tp + fn) + 0.5) / 10 END AS recall
    FROM (SELECT source, {TPFP} FROM ({JUDGED}) GROUP BY GROUPING SETS ((source), ()))"""
)
def evl_02_per_repo_and_total(t: Tables) -> DataFrame:
    c = judged(t).rollup("source").agg(*counts())
    tp, fp, fn = C("tp"), C("fp"), C("fn")
    return c.select(F.coalesce("source", F.lit("total")).alias("source"), "tp", "fp", percent(fp, tp + fp).alias("fp_rate"), percent(tp, tp + fn).alias("recall"))


@query(f"SELECT round(count(*) FILTER (WHERE quality = 1) * 1.0::DOUBLE / count(*) FILTER (WHERE toxic = 0), 9) AS decided_precision FROM ({JUDGED}) WHERE predicted = 1")
def evl_03_decided_precision(t: Tables) -> DataFrame:
    """True positives among kept rows that are not set aside (here: toxic ones)."""
    kept = judged(t).filter("predicted = 1")
    return kept.agg(F.round(F.try_divide(F.count_if(C("quality") == 1).cast("double"), F.count_if(C("toxic") == 0)), 9).alias("decided_precision"))


@query(f"SELECT doc_id FROM ({JUDGED}) WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars >= 600)")
def evl_04_recall_guard(t: Tables) -> DataFrame:
    """Labelled true rows that the rule drops."""
    kept = t.documents.filter("n_chars >= 600").select("doc_id")
    return judged(t).filter("quality = 1").join(kept, "doc_id", "left_anti").select("doc_id")


@query(
    f"""SELECT n, round(po, 9) AS agreement, round((po - pe) / (1 - pe), 9) AS kappa FROM (SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE quality = predicted) * 1.0::DOUBLE / count(*) AS po,
      (count(*) FILTER (WHERE quality = 1) * 1.0::DOUBLE * count(*) FILTER (WHERE predicted = 1) + count(*) FILTER (WHERE quality = 0) * 1.0::DOUBLE * count(*) FILTER (WHERE predicted = 0)) / (count(*) * 1.0::DOUBLE * count(*)) AS pe FROM ({JUDGED}))"""
)
def evl_05_kappa(t: Tables) -> DataFrame:
    return cohens_kappa(judged(t), "quality", "predicted").select("n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


@query(f"SELECT quality, count(*) FILTER (WHERE predicted = 0)::BIGINT AS to_0, count(*) FILTER (WHERE predicted = 1)::BIGINT AS to_1 FROM ({JUDGED}) GROUP BY 1")
def evl_06_transitions(t: Tables) -> DataFrame:
    m = judged(t).groupBy("quality").pivot("predicted", [0, 1]).agg(F.count(F.lit(1))).na.fill(0)
    return m.select("quality", C("0").alias("to_0"), C("1").alias("to_1"))


@query(
    """SELECT verdict, count(*)::BIGINT AS n FROM (SELECT CASE WHEN p.k IS NULL THEN 'new' WHEN r.k IS NULL OR p.n <> r.n THEN 'differs' ELSE 'exact' END AS verdict FROM
      (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderkey % 10 <> 3 GROUP BY 1) p FULL OUTER JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) r ON p.k = r.k) GROUP BY 1"""
)
def evl_07_reproduction(t: Tables) -> DataFrame:
    side = lambda d, n: d.groupBy(C("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias(n))
    j = side(t.orders.filter("o_orderkey % 10 <> 3"), "p").join(side(t.orders, "r"), "k", "full_outer")
    verdict = F.when(C("p").isNull(), "new").when(C("r").isNull() | (C("p") != C("r")), "differs").otherwise("exact")
    return j.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


PER_CUSTOMER = """SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus <> 'F') AS o,
  min(o_totalprice) AS lo, max(o_totalprice) AS hi, max(o_totalprice) > 3 * min(o_totalprice) AS wide FROM orders GROUP BY o_custkey"""


@query(
    f"""SELECT unnest(['sums', 'monotone', 'counts', 'at most nine', 'narrow']) AS check, unnest([count(*) FILTER (WHERE f + o <> n), count(*) FILTER (WHERE lo > hi), count(*) FILTER (WHERE n < 1),
      count(*) FILTER (WHERE n > 9), count(*) FILTER (WHERE wide)])::BIGINT AS broken FROM ({PER_CUSTOMER})"""
)
def evl_08_invariants(t: Tables) -> DataFrame:
    """Statements about results that no row may break, and two that rows do break."""
    per = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(C("o_orderstatus") == "F").alias("f"), F.count_if(C("o_orderstatus") != "F").alias("o"), F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    broken = {"sums": C("f") + C("o") != C("n"), "monotone": C("lo") > C("hi"), "counts": C("n") < 1, "at most nine": C("n") > 9, "narrow": C("hi") > 3 * C("lo")}
    a = per.agg(*[F.count_if(c).alias(k) for k, c in broken.items()])
    return a.select(F.explode(F.create_map(*[x for c in a.columns for x in (F.lit(c), C(c))])).alias("check", "broken"))


@query(
    """SELECT filter, count(*)::BIGINT AS n FROM pages, (SELECT unnest(['A', 'AB', 'ABC']) AS filter, unnest(['spam', '(spam|pills)', '(spam|pills|casino)']) AS rx) WHERE NOT regexp_matches(url, rx) GROUP BY 1"""
)
def evl_09_what_if_filters(t: Tables) -> DataFrame:
    """Nested path filters side by side in one scan."""
    u = C("url")
    a = t.pages.agg(F.count_if(~u.rlike("spam")).alias("A"), F.count_if(~u.rlike("(spam|pills)")).alias("AB"), F.count_if(~u.rlike("(spam|pills|casino)")).alias("ABC"))
    return a.unpivot([], ["A", "AB", "ABC"], "filter", "n")


@query(
    """SELECT coalesce(sum(greatest(a.n - coalesce(b.n, 0), 0)), 0)::BIGINT AS missing FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a LEFT JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k"""
)
def evl_10_round_diff(t: Tables) -> DataFrame:
    side = lambda s: t.orders.filter(C("o_orderstatus") == s).select(C("o_custkey").alias("k"))
    return multiset_difference(side("F"), side("O"), "k").agg(F.sum("missing").alias("missing"))
