"""URL filters: host-suffix and path-prefix expressions matched to rules by hash prefix.

Each url gives its host (after the first ``://`` up to / ? # or the end, A-Z lower-cased) and path (from there up to
? # or the end); null urls and urls without ``://`` have both empty and match nothing. A rule ``host/path`` fits its
host and all subdomains when the url's path starts with the rule's path. A url is expanded into its expressions: every
host suffix of a number of labels that some rule has, with every path prefix of a length that some rule has; that
leaves out only expressions that no rule can equal. Expressions meet rules in an equi-join on the first
``PREFIX_HEX`` hex digits of their SHA-256; the whole digests confirm. The longest rule wins; of a rule given with both
verdicts, block wins. Urls without a rule get the default verdict.

Rows repeated in all of (page_id, url) are folded to one with their number before anything shuffles, and unfolded at
the end, so a hot host or url costs its distinct pages. Rules are broadcast only if counted to be few. Defined cases:
null rule or verdict: the rule is left out; an empty table of pages gives an empty result, one of rules the default
for all; further columns are ignored; urls of any length are matched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small

PREFIX_HEX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row for each row of ``pages`` (page_id, url): page_id, url, host, path, rule, verdict.

    ``rules``: rule (``host/path``), verdict (allow or block).
    """
    cut = F.instr("rule", "/")
    given = rules.filter("rule is not null and verdict is not null and instr(rule, '/') > 0").select(
        "rule", "verdict", F.translate(F.substr("rule", F.lit(1), cut - 1), UPPER, LOWER).alias("rule_host"), F.substr("rule", cut).alias("rule_path"))
    given = given.groupBy("rule_host", "rule_path").agg(F.max_by(F.struct("verdict", "rule"), F.struct("verdict", "rule")).alias("r")).select("rule_host", "rule_path", "r.*")
    digest = F.sha2(F.concat_ws("/", "rule_host", "rule_path"), 256)
    given = given.select("rule", "verdict", digest.alias("rule_digest"), F.substring(digest, 1, PREFIX_HEX).alias("prefix"), (F.length("rule_host") + F.length("rule_path")).alias("rule_length"), F.size(F.split("rule_host", r"\.")).alias("labels"), F.length("rule_path").alias("path_length"))
    # at most as many numbers as a host has labels and a path has characters
    shape = given.agg(F.count(F.lit(1)), F.collect_set("labels"), F.collect_set("path_length")).first()
    n_rules, labels, lengths = shape[0], sorted(shape[1]), sorted(shape[2])

    rows = pages.select("page_id", "url").groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("times")).select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not n_rules:
        best = rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    else:
        parts = F.split("host", r"\.")
        hosts = F.filter(F.array(*[F.when(F.size(parts) >= k, F.array_join(F.slice(parts, -k, k), ".")) for k in labels]), lambda x: x.isNotNull())
        paths = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda x: x.isNotNull())
        expressions = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.sha2(F.concat_ws("/", h, p), 256))))
        asked = rows.withColumn("digest", F.explode_outer(expressions)).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
        met = asked.join(broadcast_if_small(given, n_rules), "prefix", "left")
        fits = F.when(F.col("digest") == F.col("rule_digest"), F.struct("rule_length", F.col("verdict") == "block", "rule", "verdict"))
        best = met.groupBy("page_id", "url", "times", "host", "path").agg(F.max(fits).alias("best")).select("page_id", "url", "times", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).select("page_id", "url", "host", "path", "rule", "verdict")


def op5_url_filters(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH u AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*(/[^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r(rule, h, p, v) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block'))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM (SELECT page_id, host, path, rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS k
      FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
WHERE k = 1
"""
