"""URL filters: rules on hosts and paths, found by the short hashes of a URL's expressions."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Hex digits of a digest that the join goes by.
SHORT = 8
#: Rules that are sent to all tasks at most; of more, both sides of the join are shuffled. Fixed value.
RULES_SENT = 10_000


def url_parts(url: str) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL, both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = rest
    for mark in "/?#":
        host = F.substring_index(host, mark, 1)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    for mark in "?#":
        path = F.substring_index(path, mark, 1)
    return F.translate(host, ascii_uppercase, ascii_lowercase), path


def keyed_rules(rules: DataFrame) -> DataFrame:
    """(rule, host, path, verdict, rest, digest): each rule under its host and its path up to the last slash; ``rest`` is what follows."""
    r = rules.select(F.translate("host", ascii_uppercase, ascii_lowercase).alias("host"), "path", F.lower("verdict").alias("verdict"))
    r = r.where("host is not null and path is not null and verdict in ('allow', 'block')")
    # of rules that say both, 'block' is greater
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rest = F.substring_index("path", "/", -1)
    r = r.withColumn("rest", rest).withColumn("digest", F.sha2(F.concat("host", F.expr("left(path, length(path) - length(rest))")), 256))
    return r.select(F.concat("host", "path").alias("rule"), "host", "path", "verdict", "rest", "digest", F.left("digest", F.lit(SHORT)).alias("short"))


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """Judges the url of every row of ``pages(page_id, url)`` by ``rules(host, path, verdict)``.

    A URL is expanded into the ends of its host at a dot, each with the starts of its path that end at a slash and with
    none. Expressions and rules are joined on the first 32 bits of their SHA-256; then whole digests are compared, and what
    a rule's path has after its last slash must start the rest of the URL's path. Hosts and paths are expanded as deep as
    any rule goes, which loses none and bounds a row's expressions whatever its length. Of the rules that fit, the longest
    (host and path together) decides; of equally long ones that of the longer host. An expression that very many URLs share
    is one rule's key, whose side of the join Spark splits. Up to ``RULES_SENT`` rules are sent to all tasks; the URLs' expressions
    never are, however small the files that they are read from.

    No fitting rule: rule null, verdict ``otherwise``. A null url, or one without ``://``, has an empty host and path. Rules
    with nulls or other verdicts are ignored; one that stands twice counts once, with 'block' if the verdicts differ. Repeated
    pages are returned as often as they stand there. No pages give an empty result; other columns are ignored.
    Returns page_id, host, path, rule, verdict.
    """
    host, path = url_parts("url")
    rows = cut(pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("rid")), "urls")
    found = cut(keyed_rules(rules), "url-rules")
    marks = lambda c, mark: F.length(c) - F.length(F.replace(F.col(c), F.lit(mark), F.lit("")))
    deep = found.agg(F.max(marks("host", ".")).alias("dots"), F.max(marks("path", "/")).alias("slashes"), F.max(F.length("rest")).alias("rest"), F.count("*").alias("n")).first()
    ends = F.expr(f"transform(sequence(0, least({deep.dots or 0}, length(host) - length(replace(host, '.', '')))), k -> substring_index(host, '.', -(k + 1)))")
    starts = F.expr(f"transform(sequence(0, least({deep.slashes or 0}, length(path) - length(replace(path, '/', '')))), k -> if(k = 0, '', concat(substring_index(path, '/', k), '/')))")
    each = rows.select("rid", "path", ends.alias("ends"), F.explode(starts).alias("start")).select("rid", "path", "start", F.explode("ends").alias("end"))
    digest = F.sha2(F.concat("end", "start"), 256)
    # of the path after an expression no more travels than the longest rest of a rule can compare with
    each = each.select("rid", F.expr(f"substring(path, length(start) + 1, {deep.rest or 0})").alias("after"), digest.alias("full")).withColumn("short", F.left("full", F.lit(SHORT)))
    keyed = found.select("rule", F.length("host").alias("wide"), "verdict", "rest", "digest", "short")
    fits = each.join(F.broadcast(keyed), "short") if deep.n <= RULES_SENT else each.hint("merge").join(keyed, "short")
    fits = fits.where((F.col("full") == F.col("digest")) & F.startswith("after", "rest"))
    best = fits.groupBy("rid").agg(F.max(F.struct(F.length("rule").alias("long"), "wide", "rule", "verdict")).alias("best"))
    done = rows.join(best.hint("merge"), "rid", "left")
    return done.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


#: The query's rules, as host, path and verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


ORACLE_SQL = {
    "op13_url_filter": f"""
WITH rules(rhost, rpath, v) AS (VALUES {", ".join(str(r) for r in RULES)}),
p AS (SELECT row_number() OVER () AS rid, page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), '{ascii_uppercase}', '{ascii_lowercase}'), '') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT rid, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(v, length(rhost || rpath)) AS v
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m USING (rid)
"""
}
