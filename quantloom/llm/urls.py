"""URL filter rules by hashed host-suffix and path-prefix expressions.

Every URL is expanded into (host suffix, path prefix) expressions; these meet the rules in an
equi-join on the first ``prefix_bytes`` bytes of a SHA-256 digest, and a match counts only if the
full digests agree. Host suffixes are cut at dots and have no more labels than some rule's host. Path prefixes are cut at exactly those lengths
that some rule's path has, so a rule path need not end at a slash and no expression is made that
no rule could have.

Defined results: a null URL or one without ``://`` has empty host and path and fits no rule; an
URL that fits no rule gets ``default``; among fitting rules the longest host plus path wins, then
the longer host, then ``block``; hosts and paths may be of any length; repeated pages are judged alike; other columns of the page table
are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.workspace import small_table

Rule = tuple[str, str, str]  # verdict, host, path

#: Up to this many rules are broadcast; a larger list is joined by shuffling both sides.
MAX_BROADCAST_RULES = 20_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path) of an URL; both empty where there is no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(low, F.lit("")), F.coalesce(path, F.lit(""))


def _suffixes(host: Column, most: int) -> Column:
    """What follows the last dots of a host, up to ``most`` labels; the whole host if it has fewer."""
    return F.array_distinct(F.array(*[F.substring_index(host, ".", -k) for k in range(1, most + 1)]))


def _digest(host: Column, path: Column) -> Column:
    return F.unhex(F.sha2(F.concat(host, F.lit("\x00"), path), 256))


def rule_table(spark: SparkSession, rules: Sequence[Rule], prefix_bytes: int = 4) -> DataFrame:
    seen: dict[tuple[str, str], str] = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule's verdict is allow or block, not {verdict!r}")
        if seen.get((host.lower(), path)) != "block":
            seen[host.lower(), path] = verdict
    rows = [(h, p, v) for (h, p), v in sorted(seen.items())]
    df = small_table(spark, rows, pa.schema([(c, pa.string()) for c in ("rule_host", "rule_path", "rule_verdict")]))
    d = _digest(F.col("rule_host"), F.col("rule_path"))
    return df.withColumns({"digest": d, "short": F.substring(d, 1, prefix_bytes)})


def judge_urls(pages: DataFrame, rules: Sequence[Rule], *, url: str = "url", default: str = "allow", prefix_bytes: int = 4) -> DataFrame:
    """Adds host, path, rule (host + path, or null) and verdict to ``pages``.

    The verdict depends on the URL alone, so distinct URLs are judged once and joined back; only
    URLs that fit a rule take part in that join. A table that has such columns already is refused.
    """
    if clash := {"host", "path", "rule", "verdict"} & set(pages.columns):
        raise ValueError(f"the table has {', '.join(sorted(clash))} already; rename them first")
    spark = pages.sparkSession
    lengths = sorted({len(p) for _, _, p in rules})
    most = max((h.count(".") + 1 for _, h, _ in rules), default=0)
    table = rule_table(spark, rules, prefix_bytes)
    host, path = split_url(F.col("u"))
    distinct = pages.select(F.col(url).alias("u")).where(F.locate("://", "u") > 0).distinct().select("u", host.alias("h"), path.alias("p"))
    prefixes = F.filter(F.transform(F.array(*map(F.lit, lengths)), lambda n: F.when(n <= F.length("p"), F.substring(F.col("p"), F.lit(1), n))), lambda x: x.isNotNull())
    if not lengths:
        hits = small_table(spark, [], pa.schema([(c, pa.string()) for c in ("u", "rule", "rule_verdict")]))
    else:
        grid = distinct.select("u", F.explode(_suffixes(F.col("h"), most)).alias("h"), prefixes.alias("ps")).select("u", "h", F.explode("ps").alias("p"))
        grid = grid.select("u", _digest(F.col("h"), F.col("p")).alias("own")).withColumn("short", F.substring("own", 1, prefix_bytes))
        if len(rules) <= MAX_BROADCAST_RULES:
            table = F.broadcast(table)
        fits = grid.join(table, "short").where(F.col("own") == F.col("digest"))
        best = F.max(F.struct(
            (F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("nh"), (F.col("rule_verdict") == "block").alias("b"),
            F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"))
        hits = fits.groupBy("u").agg(best.alias("best")).select("u", "best.rule", "best.rule_verdict")
    host, path = split_url(F.col(url))
    hits = hits.select(F.col("u").alias("__url"), F.col("rule").alias("__rule"), F.col("rule_verdict").alias("__verdict"))
    out = pages.join(hits, F.col(url) == F.col("__url"), "left")
    return out.select(*pages.columns, host.alias("host"), path.alias("path"), F.col("__rule").alias("rule"), F.coalesce("__verdict", F.lit(default)).alias("verdict"))


RULES: list[Rule] = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH r(verdict, rhost, rpath) AS (VALUES ('allow','org','/'),('block','example.org','/es/'),('block','example.org','/en/1'),('allow','com','/fr/'),('block','com','/de/')),
s AS (SELECT page_id, url, CASE WHEN strpos(coalesce(url,''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
v AS (SELECT u.host, u.path, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule, arg_max(r.verdict, length(r.rhost || r.rpath)) AS verdict
      FROM (SELECT DISTINCT host, path FROM p) u JOIN r ON (u.host = r.rhost OR ends_with(u.host, '.' || r.rhost)) AND starts_with(u.path, r.rpath) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, v.rule, coalesce(v.verdict, 'allow') AS verdict FROM p LEFT JOIN v ON p.host = v.host AND p.path = v.path
"""
