"""String, math, array, map and JSON functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prng import mulberry_sql
from ..functions.rules import gzip_length, percent, round_half_up, to_number, unit_number
from ..sources.tables import Tables
from .registry import query

C = F.col


@query("SELECT count(*) FILTER (WHERE regexp_matches(s, '^\\d{4}-\\d{2}-\\d{2}$'))::BIGINT AS n FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE strftime(o_orderdate, '%Y-%m-%d') END AS s FROM orders)")
def str_01_regex_count(t: Tables) -> DataFrame:
    s = F.when(C("o_orderkey") % 5 == 0, C("o_orderpriority")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select(s.alias("s")).agg(F.count_if(C("s").rlike(r"^\d{4}-\d{2}-\d{2}$")).alias("n"))


@query("SELECT page_id, regexp_extract(url, '/([0-9]+)', 1) AS num, array_to_string(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1), '|') AS heads FROM pages")
def str_02_extract(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("url", "/([0-9]+)", 1).alias("num"), F.array_join(F.regexp_extract_all("html", F.lit("<h1>([^<]*)</h1>"), 1), "|").alias("heads"))


@query("SELECT page_id, len(regexp_extract_all(html, '<p>'))::BIGINT AS n FROM pages")
def str_03_match_count(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_count("html", F.lit("<p>")).cast("bigint").alias("n"))


@query("SELECT regexp_replace(regexp_replace(o_orderpriority, '[0-9]', '#', 'g'), '\\s+', '_', 'g') AS masked, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def str_04_replace(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.regexp_replace(F.regexp_replace("o_orderpriority", "[0-9]", "#"), r"\s+", "_").alias("masked")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS head, substr(p_name, strpos(p_name, ' ') + 1) AS rest FROM part")
def str_05_split(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("head"), F.expr("substring(p_name, instr(p_name, ' ') + 1)").alias("rest"))


@query("SELECT p_partkey, lower(p_brand) || upper(p_name) AS cases, trim('  ' || p_type || ' ') AS trimmed FROM part")
def str_06_case_trim(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat(F.lower("p_brand"), F.upper("p_name")).alias("cases"), F.trim(F.concat(F.lit("  "), C("p_type"), F.lit(" "))).alias("trimmed"))


@query("SELECT page_id, starts_with(url, 'https') AS secure, ends_with(url, '/') AS slash, contains(url, 'blog') AS blog FROM pages")
def str_07_prefix_suffix(t: Tables) -> DataFrame:
    u = C("url")
    return t.pages.select("page_id", u.startswith("https").alias("secure"), u.endswith("/").alias("slash"), u.contains("blog").alias("blog"))


@query("SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 37) || '...' ELSE text END AS short FROM documents")
def str_08_truncate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.when(F.length("text") > 40, F.concat(F.substring("text", 1, 37), F.lit("..."))).otherwise(C("text")).alias("short"))


@query("SELECT p_partkey, lpad(p_size::VARCHAR, 6, '0') AS l, rpad(p_brand, 12, '.') AS r, repeat('ab', p_size % 4) AS m FROM part")
def str_09_pad_repeat(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.lpad(C("p_size").cast("string"), 6, "0").alias("l"), F.rpad("p_brand", 12, ".").alias("r"), F.repeat(F.lit("ab"), C("p_size") % 4).alias("m"))


@query("SELECT doc_id, md5(regexp_replace(text, '[ \\t\\n]+', ' ', 'g')) AS collapsed, concat_ws('-', lang, source) AS tag FROM documents")
def str_10_join_collapse(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(F.regexp_replace("text", r"[ \t\n]+", " ")).alias("collapsed"), F.concat_ws("-", "lang", "source").alias("tag"))


@query("SELECT page_id, regexp_extract(replace(url, '/', '\\'), '([^\\\\]*)$', 1) AS base, CASE WHEN contains(url, '.html') THEN 'html' ELSE '' END AS ext FROM pages")
def str_11_paths(t: Tables) -> DataFrame:
    back = F.replace("url", F.lit("/"), F.lit("\\"))
    norm = F.regexp_replace(back, r"\\", "/")
    return t.pages.select("page_id", F.substring_index(norm, "/", -1).alias("base"), F.when(C("url").contains(".html"), "html").otherwise("").alias("ext"))


@query("SELECT doc_id, substr(trim(string_split(text, chr(10))[1]), 1, 60) AS line FROM documents")
def str_12_nth_line(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.substring(F.trim(F.get(F.split("text", "\n"), 0)), 1, 60).alias("line"))


@query("SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, lower(hex(c_mktsegment)) AS h, from_base64(base64(encode(c_name)))::VARCHAR = c_name AS back FROM customer")
def str_13_hashes(t: Tables) -> DataFrame:
    b = F.unbase64(F.base64(F.encode("c_name", "UTF-8"))).cast("string")
    return t.customer.select("c_custkey", F.md5("c_name").alias("m"), F.sha2("c_name", 256).alias("s"), F.lower(F.hex("c_mktsegment")).alias("h"), (b == C("c_name")).alias("back"))


@query("SELECT doc_id, strlen(text)::BIGINT AS bytes, length(text)::BIGINT AS chars FROM documents")
def str_14_byte_length(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"), F.length("text").cast("bigint").alias("chars"))


@query()
def str_14_gzip_length(t: Tables) -> DataFrame:
    """Bytes of each text as gzip; SQL has no such function, tests hold it against the standard library."""
    return t.documents.select("doc_id", gzip_length("text").alias("bytes"))


@query("SELECT o_custkey, string_agg('<li>' || o_orderkey::VARCHAR || '</li>', '' ORDER BY o_orderkey) AS html FROM orders GROUP BY 1")
def str_15_fragments(t: Tables) -> DataFrame:
    keys = F.array_sort(F.collect_list("o_orderkey"))
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(keys, lambda k: F.concat(F.lit("<li>"), k.cast("string"), F.lit("</li>"))), "").alias("html"))


@query("SELECT DISTINCT n_chars, CASE WHEN n_chars < 1000 THEN n_chars::VARCHAR || 'ms' WHEN n_chars < 60000 THEN printf('%.1fs', floor(n_chars / 100.0::DOUBLE + 0.5) / 10) ELSE printf('%.1fm', floor(n_chars / 6000.0::DOUBLE + 0.5) / 10) END AS took FROM documents")
def str_16_durations(t: Tables) -> DataFrame:
    n = C("n_chars")
    took = F.when(n < 1000, F.concat(n.cast("string"), F.lit("ms"))).when(n < 60000, F.format_string("%.1fs", round_half_up(n / 1000.0, 1))).otherwise(F.format_string("%.1fm", round_half_up(n / 60000.0, 1)))
    return t.documents.select("n_chars", took.alias("took")).distinct()


@query("SELECT doc_id, md5(replace(text, '|', '\\|')) AS markdown, md5('\"' || replace(text, '\"', '\"\"') || '\"') AS csv FROM documents")
def str_17_escaping(t: Tables) -> DataFrame:
    q = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    return t.documents.select("doc_id", F.md5(F.replace("text", F.lit("|"), F.lit("\\|"))).alias("markdown"), F.md5(q).alias("csv"))


@query("SELECT p_partkey, round(ln(p_retailprice), 9) AS l, round(exp(p_size / 50.0::DOUBLE), 9) AS e, round(pow(p_size, 1.5::DOUBLE), 6) AS p, round(sqrt(p_size), 9) AS s, abs(p_size - 25)::BIGINT AS a, floor(p_retailprice / 7)::BIGINT AS f, ceil(p_retailprice / 7)::BIGINT AS c FROM part")
def mth_01_functions(t: Tables) -> DataFrame:
    p, x = C("p_retailprice"), C("p_size")
    return t.part.select("p_partkey", F.round(F.ln(p), 9).alias("l"), F.round(F.exp(x / 50.0), 9).alias("e"), F.round(F.pow(x, F.lit(1.5)), 6).alias("p"), F.round(F.sqrt(x), 9).alias("s"),
                         F.abs(x - 25).cast("bigint").alias("a"), F.floor(p / 7).cast("bigint").alias("f"), F.ceil(p / 7).cast("bigint").alias("c"))


@query("SELECT event_id, least(50, greatest(value, 5)) AS clamped FROM events")
def mth_02_clamp(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.least(F.lit(50.0), F.greatest("value", F.lit(5.0))).alias("clamped"))


@query("SELECT o_custkey, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') = 0 THEN NULL ELSE count(*) * 1.0::DOUBLE / count(*) FILTER (WHERE o_orderstatus = 'P') END AS speedup, floor(count(*) FILTER (WHERE o_orderstatus = 'F') * 1000.0::DOUBLE / count(*) + 0.5) / 10 AS reduction_pct FROM orders GROUP BY 1")
def mth_03_safe_ratios(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    return t.orders.groupBy("o_custkey").agg(F.try_divide(n.cast("double"), F.count_if(C("o_orderstatus") == "P")).alias("speedup"), percent(F.count_if(C("o_orderstatus") == "F"), n).alias("reduction_pct"))


@query()
def mth_04_t_distribution(t: Tables) -> DataFrame:
    """Two-sided p-values; tests hold known values."""
    from ..functions.tdist import t_p_value

    x = t.part.select("p_partkey", (C("p_retailprice") - 950) / 10, (C("p_size") + 1).cast("double")).toDF("p_partkey", "t", "df")
    return x.select("p_partkey", F.round(t_p_value("t", "df"), 9).alias("p"))


@query(mulberry_sql("p_partkey", "SELECT p_partkey FROM part", "p_partkey", "1"))
def mth_05_mulberry32(t: Tables) -> DataFrame:
    """One draw of each part's own stream; tests hold the stream against step-by-step arithmetic."""
    from ..functions.prng import mulberry32

    @F.pandas_udf("double")
    def first(seed):
        return seed.map(lambda s: mulberry32(int(s), 1)[0])

    return t.part.select("p_partkey", first("p_partkey").alias("draw"))


@query("SELECT p_partkey, ((p_partkey::DOUBLE * 2654435761.0::DOUBLE)::BIGINT & 4294967295)::BIGINT % 1000 AS bucket FROM part")
def mth_06_spread_hash(t: Tables) -> DataFrame:
    """The product is a double before it is cut to 32 bits."""
    product = (C("p_partkey").cast("double") * F.lit(2654435761.0)).cast("bigint")
    return t.part.select("p_partkey", (product.bitwiseAND(4294967295) % 1000).alias("bucket"))


@query("SELECT l_orderkey, list_sum(list_transform(list_filter(list(l_linenumber), lambda x: x % 2 = 1), lambda x: x * 2))::BIGINT AS odd_doubled FROM lineitem GROUP BY 1 HAVING len(list_filter(list(l_linenumber), lambda x: x % 2 = 1)) > 0")
def arr_01_map_filter_reduce(t: Tables) -> DataFrame:
    odd = F.filter("a", lambda x: x % 2 == 1)
    a = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("a")).filter(F.size(odd) > 0)
    return a.select("l_orderkey", F.aggregate(F.transform(odd, lambda x: x * 2), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("odd_doubled"))


@query("SELECT l_orderkey, bool_or(l_linenumber = 7) AS has_last, bool_or(l_tax > 0.07) AS some, bool_and(l_quantity > 5) AS every, min(l_linenumber) FILTER (WHERE l_linenumber > 3) AS found FROM lineitem GROUP BY 1")
def arr_02_find_some_every(t: Tables) -> DataFrame:
    a = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_tax"))).alias("a"))
    lines = F.transform("a", lambda x: x["l_linenumber"])
    return a.select("l_orderkey", F.array_contains(lines, 7).alias("has_last"), F.exists("a", lambda x: x["l_tax"] > 0.07).alias("some"), F.forall("a", lambda x: x["l_quantity"] > 5).alias("every"), F.get(F.filter(lines, lambda x: x > 3), 0).alias("found"))


@query("SELECT o_custkey, list_sort(list(o_orderkey))[2] AS second, array_to_string(list_sort(list(o_orderkey))[1:3], ',') AS head FROM orders GROUP BY 1")
def arr_03_sort_index_slice(t: Tables) -> DataFrame:
    s = F.array_sort(F.collect_list("o_orderkey"))
    return t.orders.groupBy("o_custkey").agg(s.alias("s")).select("o_custkey", F.get("s", F.lit(1)).alias("second"), F.array_join(F.transform(F.slice("s", 1, 3), lambda x: x.cast("string")), ",").alias("head"))


@query("SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def arr_04_elementwise(t: Tables) -> DataFrame:
    a = t.embeddings.select("vec_id", C("embedding").cast("array<double>").alias("x"))
    b = t.embeddings.select((C("vec_id") - 1).alias("vec_id"), C("embedding").cast("array<double>").alias("y"))
    gap = F.aggregate(F.zip_with("x", "y", lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, "vec_id").select("vec_id", F.round(gap, 6).alias("distance"))


@query("SELECT o_custkey, sum(l_linenumber)::BIGINT AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def arr_05_matrix_sum(t: Tables) -> DataFrame:
    """A matrix per customer: rows are orders, cells their lines."""
    rows = t.lineitem.groupBy(C("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("r"))
    m = t.orders.select("o_orderkey", "o_custkey").join(rows, "o_orderkey").groupBy("o_custkey").agg(F.collect_list("r").alias("m"))
    return m.select("o_custkey", F.aggregate(F.flatten("m"), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@query("SELECT shard, count(*)::BIGINT AS n FROM (SELECT (row_number() OVER (ORDER BY s_suppkey) - 1) % 4 AS shard FROM supplier) GROUP BY 1")
def arr_06_round_robin(t: Tables) -> DataFrame:
    from ..operators.windows import running_total

    n = running_total(t.supplier.select("s_suppkey", F.lit(1).alias("one")), "s_suppkey", "one", "n")
    return n.select(F.pmod(C("n") - 1, F.lit(4)).cast("bigint").alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT string_agg(event_type || '=' || n::VARCHAR, ',' ORDER BY n DESC, event_type) AS counts FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def map_01_counter(t: Tables) -> DataFrame:
    n = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    s = F.array_sort(F.collect_list(F.struct((-C("n")).alias("m"), "event_type")))
    return n.agg(F.array_join(F.transform(s, lambda x: F.concat(x["event_type"], F.lit("="), (-x["m"]).cast("string"))), ",").alias("counts"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'signup')::BIGINT AS signups FROM events GROUP BY 1")
def map_02_lookup_default(t: Tables) -> DataFrame:
    n = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return n.select("user_id", F.coalesce(F.try_element_at("m", F.lit("signup")), F.lit(0)).alias("signups"))


@query("SELECT p_partkey, unnest(['p_retailprice', 'p_size']) AS metric, unnest([p_retailprice, p_size::DOUBLE]) AS v FROM part")
def map_03_unpivot(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_retailprice", C("p_size").cast("double").alias("p_size")).unpivot("p_partkey", ["p_retailprice", "p_size"], "metric", "v")


@query("SELECT user_id, sum((props::JSON->>'k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1")
def jsn_01_parse_once(t: Tables) -> DataFrame:
    return t.events.select("user_id", F.from_json("props", "k bigint")["k"].alias("k")).groupBy("user_id").agg(F.sum("k").alias("k"))


@query("SELECT event_id, props::JSON->>'k' AS k FROM events")
def jsn_02_parse_per_row(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT event_id, props::JSON->'plan'->>'type' AS missing, coalesce(props::JSON->'plan'->>'type', 'none') AS plan FROM events")
def jsn_03_optional_chain(t: Tables) -> DataFrame:
    p = F.get_json_object("props", "$.plan.type")
    return t.events.select("event_id", p.alias("missing"), F.coalesce(p, F.lit("none")).alias("plan"))


@query("""SELECT p_partkey, '{"id":' || p_partkey::VARCHAR || ',"name":"' || p_name || '","size":' || p_size::VARCHAR || '}' AS j FROM part""")
def jsn_04_build(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.to_json(F.struct(C("p_partkey").alias("id"), C("p_name").alias("name"), C("p_size").alias("size"))).alias("j"))


@query("SELECT count(*)::BIGINT AS same FROM part")
def jsn_05_equality(t: Tables) -> DataFrame:
    """Equality by text form of a record and of the record read back."""
    j = F.to_json(F.struct("p_partkey", "p_name", "p_size"))
    back = F.to_json(F.from_json(j, "p_partkey bigint, p_name string, p_size int"))
    return t.part.agg(F.count_if(j == back).alias("same"))


@query("SELECT o_custkey, count(*)::BIGINT AS items, sum(len(o_orderkey::VARCHAR) + 7 + 1)::BIGINT + 1 AS bytes FROM orders GROUP BY 1")
def jsn_06_payload(t: Tables) -> DataFrame:
    payload = F.to_json(F.collect_list(F.struct(C("o_orderkey").alias("id"))))
    return t.orders.groupBy("o_custkey").agg(payload.alias("p")).select("o_custkey", F.json_array_length("p").cast("bigint").alias("items"), F.octet_length("p").cast("bigint").alias("bytes"))


@query("SELECT CASE WHEN k = 1 THEN -2.0::DOUBLE WHEN k = 2 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS r, k FROM range(1, 4) x(k)")
def rule_round_half_up(t: Tables) -> DataFrame:
    """-2.5 goes to -2, 2.5 to 3, -0.5 to 0."""
    d = t.spark.createDataFrame([(1, -2.5), (2, 2.5), (3, -0.5)], "k long, x double")
    return d.select(round_half_up(C("x")).alias("r"), "k")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0.0::DOUBLE ELSE o_orderkey::DOUBLE END AS n FROM orders")
def rule_to_number(t: Tables) -> DataFrame:
    """Empty cells, garbage and NaN are 0."""
    k = C("o_orderkey")
    text = F.when(k % 4 != 0, k.cast("string")).when(k % 3 == 0, "").when(k % 3 == 1, "x1").otherwise("NaN")
    return t.orders.select("o_orderkey", to_number(text).alias("n"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_size / 100.0::DOUBLE WHEN 2 THEN p_size * 1024.0::DOUBLE WHEN 3 THEN p_size * 1048576.0::DOUBLE ELSE p_size * 1000.0::DOUBLE END AS v FROM part")
def parse_07_unit_numbers(t: Tables) -> DataFrame:
    s, m = C("p_size").cast("string"), C("p_partkey") % 5
    text = F.when(m == 0, "∞").when(m == 1, F.concat(s, F.lit("%"))).when(m == 2, F.concat(s, F.lit("KB"))).when(m == 3, F.concat(s, F.lit(" MB"))).otherwise(F.concat(s, F.lit(",000")))
    return t.part.select("p_partkey", unit_number(text).alias("v"))
