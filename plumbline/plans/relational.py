"""Projections, filters, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rules import first_reason, in_locale, percent, rank_of
from ..sources.tables import Tables
from .registry import query

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
CUTOFF = "2001-05-03 00:00:00"


@query("SELECT c_custkey, c_name FROM customer")
def prj_01_subset(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name")


@query("SELECT * FROM part")
def prj_02_all_columns(t: Tables) -> DataFrame:
    return t.part.select("*")


@query("SELECT event_id, value * 2 AS doubled FROM events WHERE event_type = 'view'")
def prj_03_computed(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'view'").select("event_id", (F.col("value") * 2).alias("doubled"))


@query(
    """SELECT page_id, regexp_replace(url, '^https?://(www\\.)?', '') AS location,
      concat_ws('|', page_id::VARCHAR, regexp_replace(url, '^https?://(www\\.)?', ''), length(html)::VARCHAR) AS key FROM pages"""
)
def prj_04_rename_trim_key(t: Tables) -> DataFrame:
    location = F.regexp_replace("url", r"^https?://(www\.)?", "")
    return t.pages.select("page_id", location.alias("location"), F.concat_ws("|", F.col("page_id").cast("string"), location, F.length("html").cast("string")).alias("key"))


@query(
    """SELECT o_custkey, count(*)::BIGINT AS n, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS n_f,
      floor(count(*) FILTER (WHERE o_orderstatus = 'F') * 1000.0::DOUBLE / count(*) + 0.5) / 10 AS pct,
      CASE WHEN count(*) FILTER (WHERE o_orderpriority = '1-URGENT') = 0 THEN 0
        ELSE floor(count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') * 1000.0::DOUBLE
          / count(*) FILTER (WHERE o_orderpriority = '1-URGENT') + 0.5) / 10 END AS urgent_pct
    FROM orders GROUP BY o_custkey"""
)
def prj_05_ratios(t: Tables) -> DataFrame:
    done, urgent = F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT"
    n, f = F.count(F.lit(1)), F.count_if(done)
    return t.orders.groupBy("o_custkey").agg(
        n.alias("n"), f.alias("n_f"), percent(f, n).alias("pct"), percent(F.count_if(done & urgent), F.count_if(urgent)).alias("urgent_pct")
    )


@query(
    """SELECT conv_id, turn, line FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations) WHERE line <> ''"""
)
def prj_06_flatten(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_name = 'Customer#000000042' ORDER BY c_custkey LIMIT 1")
def flt_01_lookup(t: Tables) -> DataFrame:
    return t.customer.filter("c_name = 'Customer#000000042'").select("c_custkey", "c_acctbal").orderBy("c_custkey").limit(1)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def flt_02_foreign_key(t: Tables) -> DataFrame:
    return t.orders.filter("o_custkey = 7").select("o_orderkey", "o_totalprice")


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '{CUTOFF}'")
def flt_03_composite(t: Tables) -> DataFrame:
    return t.orders.filter((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit(CUTOFF)))).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 490000)")
def flt_04_in_computed_set(t: Tables) -> DataFrame:
    wanted = t.orders.filter("o_totalprice > 490000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey", "c_name").join(wanted, "c_custkey", "left_semi")


@query("SELECT event_id, value * 2 AS doubled FROM (SELECT *, CASE WHEN event_type = 'error' THEN NULL ELSE value > 50 END AS active FROM events) WHERE active")
def flt_05_boolean(t: Tables) -> DataFrame:
    active = F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("value") > 50)
    return t.events.withColumn("active", active).filter("active").select("event_id", (F.col("value") * 2).alias("doubled"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '/(en|de)/[0-9]+') AND NOT regexp_matches(url, '(spam|pills|casino)')")
def flt_06_include_exclude(t: Tables) -> DataFrame:
    return t.pages.select("page_id", "url").filter(F.col("url").rlike("/(en|de)/[0-9]+") & ~F.col("url").rlike("(spam|pills|casino)"))


@query(
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND o_totalprice >= 450000"
)
def flt_07_members_and_rank(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderstatus").isin("O", "P") & (rank_of(F.col("o_orderpriority"), PRIORITIES) <= 2) & (F.col("o_totalprice") >= 450000)).select(
        "o_orderkey", "o_orderpriority"
    )


FUNNEL_SQL = """
  SELECT doc_id, CASE WHEN n_chars < 500 THEN 'too-short' WHEN lang <> 'en' THEN 'language' WHEN regexp_matches(text, '[|#%$]{3}| [|] ') THEN 'junk'
    WHEN row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 THEN 'duplicate' END AS reason FROM documents"""


def funnel(t: Tables) -> DataFrame:
    """The first of a content hash comes from an aggregation joined back, so a text that fills a third of all rows is no single task."""
    d = t.documents.select("doc_id", "n_chars", "lang", F.md5("text").alias("digest"), F.col("text").rlike(r"[|#%$]{3}| [|] ").alias("junk"))
    first = d.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    copy = F.col("doc_id") > F.col("first_id")
    rules = ((F.col("n_chars") < 500, "too-short"), (F.col("lang") != "en", "language"), (F.col("junk"), "junk"), (copy, "duplicate"))
    return d.join(first, "digest").select("doc_id", first_reason(*rules).alias("reason"))


@query(FUNNEL_SQL)
def flt_08_exclusion_funnel(t: Tables) -> DataFrame:
    return funnel(t)


@query(f"SELECT coalesce(reason, 'kept') AS reason, count(*)::BIGINT AS n FROM ({FUNNEL_SQL}) GROUP BY 1")
def flt_08_funnel_counts(t: Tables) -> DataFrame:
    return funnel(t).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(concat_ws(' ', p_name, p_brand, p_type), '(?i)\\b(RING|economy)\\b')")
def flt_09_word_match(t: Tables) -> DataFrame:
    return t.part.filter(F.concat_ws(" ", "p_name", "p_brand", "p_type").rlike(r"(?i)\b(RING|economy)\b")).select("p_partkey", "p_name")


@query(
    """SELECT o.o_orderkey FROM orders o WHERE o.o_orderstatus = 'F'
      OR EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_discount = 0 AND l.l_tax = 0)"""
)
def flt_10_usable(t: Tables) -> DataFrame:
    tries = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct("l_discount", "l_tax")).alias("tries"))
    exact = F.exists("tries", lambda a: (a["l_discount"] == 0) & (a["l_tax"] == 0))
    return t.orders.select("o_orderkey", "o_orderstatus").join(tries, "o_orderkey", "left").filter((F.col("o_orderstatus") == "F") | exact).select("o_orderkey")


@query("SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def flt_11_first_seen(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def srt_01_newest(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 15")
def srt_02_top_k(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_custkey").limit(15)


@query("SELECT p_brand, p_size, p_name, p_partkey FROM part ORDER BY p_brand, p_size, p_name, p_partkey")
def srt_03_multi_key(t: Tables) -> DataFrame:
    """Byte order of text, a unique key last; a range sort over all rows."""
    return t.part.select("p_brand", "p_size", "p_name", "p_partkey").orderBy("p_brand", "p_size", "p_name", "p_partkey")


SPELLED = "CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'e', 'é') WHEN 2 THEN replace(p_name, 'a', 'Á') WHEN 3 THEN replace(p_name, ' ', '-') ELSE p_name END"


@query(f"SELECT name, p_size, p_partkey, row_number() OVER (ORDER BY name COLLATE en, p_size, p_partkey)::INT AS place FROM (SELECT {SPELLED} AS name, p_size, p_partkey FROM part) ORDER BY place LIMIT 500")
def srt_03_locale_order(t: Tables) -> DataFrame:
    """The first 500 by a locale's order of mixed case, accents and hyphens, then size and key."""
    named = t.part.select(F.expr(SPELLED).alias("name"), "p_size", "p_partkey")
    first = named.orderBy(in_locale(F.col("name")), "p_size", "p_partkey").limit(500)
    return first.withColumn("place", F.row_number().over(W.orderBy(in_locale(F.col("name")), "p_size", "p_partkey")))


@query(f"SELECT r_name, count(*) AS n FROM (SELECT icu_sort_key(p_brand, 'en') AS k FROM part) JOIN (SELECT r_name, icu_sort_key('Brand#' || (r_regionkey + 1)::VARCHAR || '1', 'en') AS k FROM region) USING (k) GROUP BY r_name")
def srt_03_locale_join(t: Tables) -> DataFrame:
    """Keys equal in the locale's eyes meet."""
    r = t.region.select("r_name", in_locale(F.concat(F.lit("Brand#"), (F.col("r_regionkey") + 1).cast("string"), F.lit("1"))).alias("k"))
    return t.part.select(in_locale(F.col("p_brand")).alias("k")).join(r, "k").groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT list(s ORDER BY s)::VARCHAR AS sizes FROM (SELECT DISTINCT p_size AS s FROM part)")
def srt_04_numeric(t: Tables) -> DataFrame:
    sizes = t.part.agg(F.array_sort(F.collect_set("p_size")).alias("s"))
    return sizes.select(F.concat(F.lit("["), F.concat_ws(", ", F.transform("s", lambda x: x.cast("string"))), F.lit("]")).alias("sizes"))


@query(
    """SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1
      WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 3 ELSE 4 END, o_totalprice DESC, o_orderkey LIMIT 50"""
)
def srt_05_by_rank(t: Tables) -> DataFrame:
    rank = rank_of(F.col("o_orderpriority"), PRIORITIES)
    return t.orders.filter("o_orderstatus = 'P'").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey")


@query(
    """SELECT o_orderkey, coalesce(last_price, 0) AS last_price FROM orders LEFT JOIN (
      SELECT l_orderkey, arg_max(l_extendedprice, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS last_price FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
      ORDER BY coalesce(last_price, 0) DESC, o_orderkey LIMIT 30"""
)
def srt_06_by_last_element(t: Tables) -> DataFrame:
    lists = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).alias("r")
    )
    last = F.coalesce(F.get("r", F.size("r") - 1)["l_extendedprice"], F.lit(0.0))
    return t.orders.select("o_orderkey").join(lists, "o_orderkey", "left").select("o_orderkey", last.alias("last_price")).orderBy(F.desc("last_price"), "o_orderkey").limit(30)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def lim_01_take(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").orderBy("o_orderkey").limit(100)


@query("SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= ceil(100 / 7.0)")
def lim_02_equal_share(t: Tables) -> DataFrame:
    w = W.partitionBy("o_orderpriority").orderBy("o_orderkey")
    return t.orders.select("o_orderkey", "o_orderpriority", F.row_number().over(w).alias("rn")).filter("rn <= ceil(100 / 7.0)").drop("rn")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 199 ORDER BY o_orderkey LIMIT 100")
def lim_03_keyset_page(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderkey > 199").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(100)


@query("SELECT DISTINCT user_id, event_type FROM events")
def set_01_distinct(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_type").distinct()


@query("SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region")
def set_02_union_all(t: Tables) -> DataFrame:
    nations = t.nation.select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    return nations.unionByName(t.region.select(F.lit("region").alias("kind"), F.col("r_name").alias("name")))


@query("SELECT event_id, event_id % 3 AS shard FROM events ORDER BY event_id")
def set_03_merge_shards(t: Tables) -> DataFrame:
    """Shards with disjoint keys come together and return to input order (a range sort)."""
    e = t.events.select("event_id", (F.col("event_id") % 3).alias("shard"))
    merged = e.filter("shard = 0").unionByName(e.filter("shard = 1")).unionByName(e.filter("shard = 2"))
    return merged.orderBy("event_id")


@query("SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def set_04_except(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("k")).subtract(t.lineitem.select(F.col("l_orderkey").alias("k")))


@query("SELECT doc_id AS k FROM documents INTERSECT SELECT doc_id FROM labels")
def set_05_intersect(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("k")).intersect(t.labels.select(F.col("doc_id").alias("k")))


@query(
    """WITH n AS (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), o AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'purchase')
    SELECT coalesce(sum(n) FILTER (WHERE n.k IS NOT NULL AND o.k IS NOT NULL), 0)::BIGINT AS both_new,
      count(*) FILTER (WHERE n.k IS NOT NULL AND o.k IS NOT NULL)::BIGINT AS both_old,
      coalesce(sum(n) FILTER (WHERE o.k IS NULL), 0)::BIGINT AS new_only, count(*) FILTER (WHERE n.k IS NULL)::BIGINT AS old_only FROM n FULL OUTER JOIN o ON n.k = o.k"""
)
def set_06_overlap(t: Tables) -> DataFrame:
    new = t.events.filter("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    old = t.events.filter("event_type = 'purchase'").select("user_id").distinct().withColumn("o", F.lit(1))
    j = new.join(old, "user_id", "full_outer")
    both = F.col("n").isNotNull() & F.col("o").isNotNull()
    return j.agg(
        F.coalesce(F.sum(F.when(both, F.col("n"))), F.lit(0)).alias("both_new"),
        F.count_if(both).alias("both_old"),
        F.coalesce(F.sum(F.when(F.col("o").isNull(), F.col("n"))), F.lit(0)).alias("new_only"),
        F.count_if(F.col("n").isNull()).alias("old_only"),
    )


@query(
    """WITH i AS (SELECT o_custkey AS k, list(o_orderpriority ORDER BY o_orderkey) AS cols FROM orders GROUP BY 1)
    SELECT k, len(cols) >= 2 AND list_sort(cols[1:2]) = ['1-URGENT', '2-HIGH'] AS covered FROM i"""
)
def set_07_prefix_coverage(t: Tables) -> DataFrame:
    """An index covers a key if its leading columns are exactly the key's, in any order."""
    key = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    cols = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("i"))
    lead = F.slice(F.transform("i", lambda x: x["o_orderpriority"]), 1, 2)
    return cols.select("k", ((F.size("i") >= 2) & (F.array_sort(lead) == key)).alias("covered"))
