"""Joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rules import rank_of
from ..operators.joins import eager_load, first_match, multiset_difference, patch, require_all, suffix_match
from ..sources.tables import Tables, require
from .registry import query
from .relational import PRIORITIES

C = F.col


@query(
    """SELECT o_orderkey, coalesce(n, 0)::BIGINT AS n_items, coalesce(items, '') AS items FROM orders LEFT JOIN (
      SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber::VARCHAR || ':' || l_partkey::VARCHAR || ':' || l_suppkey::VARCHAR, ';'
        ORDER BY l_linenumber, l_partkey, l_suppkey) AS items FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
)
def join_01_eager_load(t: Tables) -> DataFrame:
    loaded = eager_load(t.orders.select("o_orderkey"), t.lineitem, "o_orderkey", "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey"), "items")
    text = F.array_join(F.transform("items", lambda i: F.concat_ws(":", i["l_linenumber"].cast("string"), i["l_partkey"].cast("string"), i["l_suppkey"].cast("string"))), ";")
    return loaded.select("o_orderkey", F.size("items").cast("bigint").alias("n_items"), text.alias("items"))


@query(
    """SELECT c_custkey, coalesce(tree, '') AS tree FROM customer LEFT JOIN (
      SELECT o_custkey, string_agg(o_orderkey::VARCHAR || '[' || coalesce(items, '') || ']', ' ' ORDER BY o_orderkey) AS tree FROM orders LEFT JOIN (
        SELECT l_orderkey, string_agg(l_linenumber::VARCHAR || ':' || l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS items FROM lineitem GROUP BY 1)
      ON l_orderkey = o_orderkey GROUP BY 1) ON o_custkey = c_custkey"""
)
def join_02_nested_load(t: Tables) -> DataFrame:
    orders = eager_load(t.orders.select("o_custkey", "o_orderkey"), t.lineitem, "o_orderkey", "l_orderkey", F.struct("l_linenumber", "l_partkey"), "items")
    full = eager_load(t.customer.select("c_custkey"), orders, "c_custkey", "o_custkey", F.struct("o_orderkey", "items"), "orders")
    items = lambda o: F.array_join(F.transform(o["items"], lambda i: F.concat_ws(":", i["l_linenumber"].cast("string"), i["l_partkey"].cast("string"))), ",")
    tree = F.array_join(F.transform("orders", lambda o: F.concat(o["o_orderkey"].cast("string"), F.lit("["), items(o), F.lit("]"))), " ")
    return full.select("c_custkey", tree.alias("tree"))


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_03_many_to_one(t: Tables) -> DataFrame:
    """No hint: Spark broadcasts the looked-up side while its size allows and shuffles beyond."""
    names = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return t.orders.select("o_orderkey", "o_custkey").join(names, "o_custkey", "left").select("o_orderkey", "c_name")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'")
def join_04_conditional(t: Tables) -> DataFrame:
    o, c = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), t.customer.select("c_custkey", "c_name")
    return o.join(c, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderpriority") == "1-URGENT"), "left").select("o_orderkey", "c_name")


N_PLUS_ONE = "SELECT c_custkey, (SELECT count(*) FROM {o} WHERE o_custkey = c_custkey) AS n, (SELECT coalesce(max(o_totalprice), 0) FROM {o} WHERE o_custkey = c_custkey) AS top FROM {c}"


@query(N_PLUS_ONE.format(o="orders", c="customer"))
def join_05_correlated(t: Tables) -> DataFrame:
    """Written as a query for each row; Catalyst turns it into joins."""
    return t.spark.sql(N_PLUS_ONE, o=t.orders, c=t.customer)


@query("SELECT c_custkey, n, top FROM customer JOIN LATERAL (SELECT count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_custkey = c_custkey) ON true WHERE n > 0")
def join_06_parallel_lookups(t: Tables) -> DataFrame:
    many = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    return t.customer.select("c_custkey").join(many, "c_custkey")


@query(
    """SELECT event_id AS pos, user_id, c_name FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'error' AND c_custkey % 10 <> 0"""
)
def join_07_batched_lookup(t: Tables) -> DataFrame:
    """Request order and repeats stay; missing and unsubscribed users go."""
    users = t.customer.filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("user_id"), "c_name")
    return t.events.filter("event_type = 'error'").select(F.col("event_id").alias("pos"), "user_id").join(users, "user_id")


FIRST_SQL = """SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'F') ON o_custkey = c_custkey AND rn = 1"""


@query(FIRST_SQL)
def join_08_first_match_loop(t: Tables) -> DataFrame:
    o = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return first_match(t.customer.select("c_custkey"), o, "c_custkey", "o_orderkey")


@query(FIRST_SQL)
def join_09_first_match_hash(t: Tables) -> DataFrame:
    w = W.partitionBy("c_custkey").orderBy("o_orderkey")
    o = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return t.customer.select("c_custkey").join(o.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn"), "c_custkey", "left")


@query(
    """SELECT coalesce(l.quality::VARCHAR, 'unplaced') AS place, count(*)::BIGINT AS n, count(*) FILTER (WHERE l.doc_id IS NULL)::BIGINT AS unplaced
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1"""
)
def join_10_unmatched_counted(t: Tables) -> DataFrame:
    j = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return j.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("unplaced")).alias("place")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality").isNull()).alias("unplaced"))


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def join_11_complete(t: Tables) -> DataFrame:
    c = require(t.customer, "c_custkey", "c_mktsegment").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return require_all(t.orders.select("o_orderkey", "o_custkey"), c, "o_custkey").select("o_orderkey", "c_mktsegment")


@query(
    """SELECT c.conv_id, c.turn, coalesce(n.role, '') AS next_role FROM conversations c LEFT JOIN conversations n ON c.conv_id = n.conv_id AND c.turn + 1 = n.turn"""
)
def join_12_composite_key(t: Tables) -> DataFrame:
    after = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next_role"))
    return t.conversations.select("conv_id", "turn").join(after, ["conv_id", "turn"], "left").withColumn("next_role", F.coalesce("next_role", F.lit("")))


@query("SELECT p_partkey, n FROM part JOIN (SELECT lower(upper(p_type)) AS k, count(*)::BIGINT AS n FROM part GROUP BY 1) ON lower(p_type) = k")
def join_13_any_case(t: Tables) -> DataFrame:
    sizes = t.part.groupBy(F.lower(F.upper("p_type")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return t.part.select("p_partkey", F.lower("p_type").alias("k")).join(sizes, "k").select("p_partkey", "n")


@query(
    """SELECT s.sample, l.quality FROM (SELECT min(doc_id) AS loc, unnest(list(doc_id)) AS sample FROM documents GROUP BY md5(text)) s JOIN labels l ON l.doc_id = s.loc"""
)
def join_14_two_hops(t: Tables) -> DataFrame:
    """Sample -> location (the first document of its text) -> label; no list of a text's samples is built."""
    d = t.documents.select(C("doc_id").alias("sample"), F.md5("text").alias("k"))
    hop = d.join(d.groupBy("k").agg(F.min("sample").alias("loc")), "k")
    return hop.join(t.labels.select(C("doc_id").alias("loc"), "quality"), "loc").select("sample", "quality")


@query("SELECT count(*)::BIGINT AS n FROM (SELECT DISTINCT user_id, event_type FROM events WHERE value > 100) WHERE user_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def join_15_semi(t: Tables) -> DataFrame:
    seen = t.events.filter("value > 100").select("user_id", "event_type").dropDuplicates()
    return seen.join(t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_id")), "user_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def join_16_anti(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


SUFFIXES = [".html", "#top", "feed", "/", "l"]


@query(
    """SELECT page_id, CASE WHEN ends_with(url, '.html') THEN '.html' WHEN ends_with(url, '#top') THEN '#top' WHEN ends_with(url, 'feed') THEN 'feed'
      WHEN ends_with(url, '/') THEN '/' WHEN ends_with(url, 'l') THEN 'l' END AS label FROM pages"""
)
def join_17_suffix(t: Tables) -> DataFrame:
    labels = t.spark.createDataFrame(list(enumerate(SUFFIXES)), "pos int, label string")
    return suffix_match(t.pages.select("page_id", "url"), "url", labels, "label", "pos").select("page_id", "label")


@query(
    """SELECT conv_id, turn, blame FROM conversations LEFT JOIN (SELECT conv_id AS c, turn AS l, md5(text) AS blame FROM conversations WHERE role = 'user') ON conv_id = c AND turn = l"""
)
def join_18_positional(t: Tables) -> DataFrame:
    lines = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.md5("text").alias("blame"))
    return t.conversations.select("conv_id", "turn").join(lines, ["conv_id", "turn"], "left")


@query(
    """SELECT l_returnflag, l_linenumber, base, opt, base / opt AS speedup FROM (SELECT l_returnflag, l_linenumber, sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS base,
      sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS opt FROM lineitem GROUP BY 1, 2) WHERE base IS NOT NULL AND opt IS NOT NULL"""
)
def join_19_baseline_pairs(t: Tables) -> DataFrame:
    """One pass of conditional sums instead of a self-join."""
    of = lambda s: F.sum(F.when(F.col("l_linestatus") == s, F.col("l_quantity")))
    pairs = t.lineitem.groupBy("l_returnflag", "l_linenumber").agg(of("O").alias("base"), of("F").alias("opt"))
    return pairs.dropna(subset=["base", "opt"]).withColumn("speedup", F.col("base") / F.col("opt"))


@query(
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missed' WHEN a.k IS NULL THEN 'extra' WHEN a.n <> b.n THEN 'differs' ELSE 'same' END AS verdict
    FROM (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1) a FULL OUTER JOIN (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) b ON a.k = b.k"""
)
def join_20_compare_sets(t: Tables) -> DataFrame:
    side = lambda kind, n: t.events.filter(F.col("event_type") == kind).groupBy(F.col("user_id").alias("k")).agg(F.count(F.lit(1)).alias(n))
    j = side("signup", "a").join(side("error", "b"), "k", "full_outer")
    verdict = F.when(F.col("b").isNull(), "missed").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "differs").otherwise("same")
    return j.select("k", verdict.alias("verdict"))


@query(
    """SELECT coalesce(a.k, b.k) AS k, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0)::BIGINT AS missing, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0)::BIGINT AS extra
    FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) a FULL OUTER JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) b ON a.k = b.k"""
)
def join_21_multiset_difference(t: Tables) -> DataFrame:
    side = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return multiset_difference(side("O"), side("P"), "k")


SIGNATURES = "SELECT c_mktsegment, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey"
OTHER_WAY = "SELECT c_mktsegment, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 1000 <> 7 UNION ALL SELECT 'NONE', 'X' FROM region"


@query(
    f"""SELECT 'same' AS pair, (SELECT count(*) FROM ({SIGNATURES} EXCEPT ALL {SIGNATURES}))::BIGINT AS missing, (SELECT count(*) FROM ({SIGNATURES} EXCEPT ALL {SIGNATURES}))::BIGINT AS extra
    UNION ALL SELECT 'changed', (SELECT count(*) FROM (({SIGNATURES}) EXCEPT ALL ({OTHER_WAY})))::BIGINT, (SELECT count(*) FROM (({OTHER_WAY}) EXCEPT ALL ({SIGNATURES})))::BIGINT"""
)
def join_22_multiset_equal(t: Tables) -> DataFrame:
    """Multisets of (segment, status) signatures: one made in two ways, and one that lost rows and gained five."""
    o, c = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    a = o.join(c, "o_custkey").select("c_mktsegment", "o_orderstatus")
    counted = o.groupBy("o_custkey", "o_orderstatus").count().join(c, "o_custkey").select("c_mktsegment", "o_orderstatus", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("i")).drop("i")
    changed = o.filter("o_orderkey % 1000 <> 7").join(c, "o_custkey").select("c_mktsegment", "o_orderstatus").unionByName(t.region.select(F.lit("NONE").alias("c_mktsegment"), F.lit("X").alias("o_orderstatus")))
    out = None
    for pair, b in (("same", counted), ("changed", changed)):
        d = multiset_difference(a, b, "c_mktsegment", "o_orderstatus").agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"), F.coalesce(F.sum("extra"), F.lit(0)).alias("extra"))
        d = d.select(F.lit(pair).alias("pair"), "missing", "extra")
        out = d if out is None else out.unionByName(d)
    return out


@query("SELECT y, x, (y * 10 + x)::BIGINT AS cell FROM range(0, 5) a(y), range(1, 7) b(x)")
def join_23_axes(t: Tables) -> DataFrame:
    """Two fixed axes of a grid; both have a literal length."""
    return t.spark.range(5).withColumnRenamed("id", "y").crossJoin(t.spark.range(1, 7).withColumnRenamed("id", "x")).select("y", "x", (F.col("y") * 10 + F.col("x")).alias("cell"))


@query("SELECT DISTINCT n_nationkey, upper(substr(lower(r_name), 1, 1)) || substr(lower(r_name), 2) AS model FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_24_capitalised(t: Tables) -> DataFrame:
    model = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.expr(f"substring({c}, 2)"))
    sites = t.nation.join(t.region.select(F.col("r_regionkey").alias("n_regionkey"), F.lower("r_name").alias("site")), "n_regionkey").select("n_nationkey", model("site").alias("model"))
    models = t.region.select(F.lower("r_name").alias("m")).select(model("m").alias("model"))
    return sites.join(models, "model").select("n_nationkey", "model").distinct()


@query(
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1.5::DOUBLE WHEN '2-HIGH' THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END * o_totalprice AS weighted FROM orders"""
)
def join_25_static_dimension(t: Tables) -> DataFrame:
    dim = t.spark.createDataFrame([("1-URGENT", 1.5), ("2-HIGH", 1.2)], "o_orderpriority string, factor double")
    j = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice").join(F.broadcast(dim), "o_orderpriority", "left")
    return j.select("o_orderkey", (F.coalesce("factor", F.lit(1.0)) * F.col("o_totalprice")).alias("weighted"))


@query(
    """SELECT event_type, n, CASE event_type WHEN 'error' THEN 'fix' WHEN 'view' THEN 'cache' ELSE 'none' END AS advice FROM (
      SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1)"""
)
def join_26_recommendations(t: Tables) -> DataFrame:
    advice = t.spark.createDataFrame([("error", "fix"), ("view", "cache")], "event_type string, advice string")
    counts = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(advice), "event_type", "left").withColumn("advice", F.coalesce("advice", F.lit("none"))).orderBy(F.desc("n"), "event_type")


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey IN (3, 5) THEN 'patched' ELSE s_name END AS s_name, s_suppkey IN (3, 5) AS patched FROM supplier"""
)
def join_27_patch(t: Tables) -> DataFrame:
    patches = t.spark.createDataFrame([(3, "patched"), (5, "patched"), (-1, "nowhere")], "s_suppkey long, s_name string")
    return patch(t.supplier.select("s_suppkey", "s_name"), patches, "s_suppkey", "s_name")


@query(
    """SELECT user_id, coalesce(max(value) FILTER (WHERE event_type = 'purchase' AND value > 200), max(value) FILTER (WHERE event_type = 'view' AND value > 150), 0) AS metric FROM events GROUP BY 1"""
)
def join_28_fallback_chain(t: Tables) -> DataFrame:
    of = lambda kind, low: F.max(F.when((F.col("event_type") == kind) & (F.col("value") > low), F.col("value")))
    nan_out = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    return t.events.groupBy("user_id").agg(of("purchase", 200).alias("a"), of("view", 150).alias("b")).select("user_id", F.coalesce(nan_out(F.col("a")), nan_out(F.col("b")), F.lit(0.0)).alias("metric"))


@query("SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def flagship_open_orders(t: Tables) -> DataFrame:
    """Composite filter, lookup, count and top-k."""
    recent = t.orders.filter("o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP_NTZ '1998-01-01'").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    counted = recent.join(t.customer.select("c_custkey"), "c_custkey").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), rank_of(F.col("o_orderpriority"), PRIORITIES)).limit(10)
