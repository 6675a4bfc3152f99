"""URL filters by host-suffix / path-prefix expressions.

Each URL is expanded into the expressions `host suffix + path prefix` that a
rule could have, the SHA-256 digest of each is cut to a 32-bit prefix, and an
equi-join on that prefix finds the rules that may match; the full digest
confirms, and precedence (longest rule) decides. The host suffixes meet the
hosts of rules first, in the same way; only a host that has rules is expanded,
by the path lengths that its own rules have.

Shape at scale: rows are counted by distinct (host, path) first, on the map
side, and only these are expanded and joined (rules are broadcast while their
counted number stays within `broadcast_rules`; beyond it Spark shuffles both
sides by prefix). So a host or URL with a third of all pages is decided once
a path. Decisions go back to the rows by their counts: those of URLs with over a
thousandth of all rows by broadcast, so these rows are not shuffled, the others by a plain join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, spread_join, written

#: Rules are broadcast up to this counted number (about 200 bytes each).
BROADCAST_RULES = 200_000

URL_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL_PATTERN, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, URL_PATTERN, 2), F.lit(""))


def digested_rules(rules: DataFrame) -> DataFrame:
    """`rules` has host, path, verdict; adds the rule's text, digest and short prefix. Null or empty hosts are no rules."""
    text = F.concat(ascii_lower(F.col("host")), F.coalesce(F.col("path"), F.lit("")))
    r = rules.where(F.col("host").isNotNull() & (F.col("host") != "") & F.col("verdict").isNotNull()).select(
        text.alias("__rule"),
        F.col("verdict").alias("__verdict"),
        F.sha2(text, 256).alias("__digest"),
        ascii_lower(F.col("host")).alias("__host"),
        F.size(F.split("host", r"\.")).alias("__labels"),
        F.length(F.coalesce(F.col("path"), F.lit(""))).alias("__plen"),
        (F.length("host")).alias("__hlen"),
    )
    return r.withColumn("__prefix", F.substring("__digest", 1, 8))


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    default: str = "allow",
    broadcast_rules: int = BROADCAST_RULES,
) -> DataFrame:
    """Adds host, path, rule and verdict to every row of `pages`.

    A rule fits its host and all subdomains if the path starts with the rule's
    path. The longest rule (host and path together) wins; of two equally long
    the longer host, then `allow`. No rule: rule null, verdict `default`.

    Null urls and urls without `://` have an empty host and path and meet no
    rule. Repeated rows stay. Columns of `pages` named host, path, rule or
    verdict are replaced. Repeated rules count once; an empty rule table
    leaves `default` everywhere.
    """
    digested = digested_rules(rules)
    # One row of bounds: no suffix longer than the longest host of a rule is expanded.
    bound = digested.agg(F.max("__labels").alias("labels"), F.count(F.lit(1)).alias("n")).first()
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*[F.col(f"`{c}`") for c in keep], url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"))
    if not bound["n"]:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.greatest(F.lit(1), F.size(labels) - F.lit(bound["labels"]) + 1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    prefixes = F.transform(F.filter("__plens", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    # The lengths of one host are at most those of its longest path, and few.
    hosts = digested.groupBy(F.sha2("__host", 256).alias("__host_digest")).agg(F.collect_set("__plen").alias("__plens"))
    hosts = hosts.withColumn("__host_prefix", F.substring("__host_digest", 1, 8))
    small = digested.select("__prefix", "__digest", "__rule", "__verdict", "__hlen")
    if bound["n"] <= broadcast_rules:
        hosts, small = F.broadcast(hosts), F.broadcast(small)
    urls = written(parsed.groupBy("host", "path").agg(F.count(F.lit(1)).alias("__n")), "urls")
    expressions = (
        urls.where(F.col("host") != "")
        .select("host", "path", F.explode(suffixes).alias("__s"))
        .withColumn("__host_full", F.sha2("__s", 256))
        .withColumn("__host_prefix", F.substring("__host_full", 1, 8))
        .join(hosts, "__host_prefix")
        .where(F.col("__host_full") == F.col("__host_digest"))
        .select("host", "path", "__s", F.explode(prefixes).alias("__p"))
        .select("host", "path", F.sha2(F.concat("__s", "__p"), 256).alias("__full"))
        .withColumn("__prefix", F.substring("__full", 1, 8))
    )
    rank = F.struct(F.length("__rule"), F.col("__hlen"), F.when(F.col("__verdict") == "allow", 1).otherwise(0), F.col("__rule"))
    decisions = (
        expressions.join(small, "__prefix")
        .where(F.col("__full") == F.col("__digest"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict")), rank).alias("__d"))
        .select("host", "path", "__d.rule", "__d.verdict")
    )
    facts = written(urls.join(decisions, ["host", "path"], "left"), "decisions")
    discard(urls)
    total = facts.agg(F.sum("__n")).first()[0] or 0
    return spread_join(parsed, facts, ["host", "path"], total).select(*[F.col(f"`{c}`") for c in keep], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
