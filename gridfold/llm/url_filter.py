"""Allow and block rules over URLs, by hashed host-suffix and path-prefix expressions.

Every URL is expanded into the (host suffix + path prefix) expressions that some rule could
have: only suffixes with as many labels, and prefixes with as many characters, as a rule has.
Expressions meet the rules by an equi-join on the first digits of their SHA-256; full digests
are then confirmed, and the longest rule decides. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfold.llm.common import ascii_lower

#: Rule tables of up to so many rows are broadcast (about 200 bytes a row); longer ones shuffle.
BROADCAST_RULES = 100_000
#: Hexadecimal digits of the join key.
SHORT = 8


@dataclass(frozen=True)
class Rule:
    action: str  # "allow" or "block"
    host: str
    path: str

    @classmethod
    def parse(cls, action: str, text: str) -> "Rule":
        host, slash, rest = text.partition("/")
        return cls(action, host.lower(), slash + rest)


def url_host(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(_after(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules with their digests; of two alike the blocking one stays."""
    best: dict[tuple[str, str], Rule] = {}
    for r in rules:
        if (r.host, r.path) not in best or r.action == "block":
            best[r.host, r.path] = r
    rows = [(r.action, r.host, r.path) for r in best.values()]
    if len(rows) <= 1000:
        cells = [F.struct(*(F.lit(v).alias(n) for v, n in zip(row, ("action", "rule_host", "rule_path")))) for row in rows]
        empty = F.array().cast("array<struct<action:string,rule_host:string,rule_path:string>>")
        out = spark.range(1).select(F.inline(F.array(*cells) if cells else empty))
    else:
        out = spark.createDataFrame(rows, "action string, rule_host string, rule_path string")
    rule = F.concat("rule_host", "rule_path")
    return out.select("action", "rule_host", rule.alias("rule"), F.sha2(rule, 256).alias("digest"))


def judge_urls(urls: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """Distinct values of column `url` with host, path, rule and verdict.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest
    rule (characters of host and path) wins; between equally long ones the longer host, then
    block. Without a rule: rule null and the verdict `default`. Null urls, and those without
    "://", have an empty host and path, which a rule fits only if it has an empty host.
    """
    spark = urls.sparkSession
    known = urls.select("url").distinct().select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    if not rules:
        return known.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    table = rules_table(spark, rules).withColumn("short", F.substring("digest", 1, SHORT))
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)
    labels = F.size(F.split("host", r"\."))
    some = [
        F.when((labels >= n) & (F.length("path") >= k), F.concat(F.substring_index("host", ".", -n), F.substring("path", 1, k)))
        for n in sorted({r.host.count(".") + 1 for r in rules})
        for k in sorted({len(r.path) for r in rules})
    ]
    asked = (
        known.select("url", F.explode(F.array_compact(F.array(*some))).alias("expression"))
        .withColumn("asked", F.sha2("expression", 256))
        .withColumn("short", F.substring("asked", 1, SHORT))
    )
    order = F.struct(F.length("rule"), F.length("rule_host"), F.col("action") == "block", "rule")
    won = (
        asked.join(table, "short")
        .where(F.col("asked") == F.col("digest"))
        .groupBy("url")
        .agg(F.max_by(F.struct("rule", "action"), order).alias("won"))
    )
    return known.join(won, "url", "left").select("url", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.action", F.lit(default)).alias("verdict"))


def filter_pages(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict added (columns so named are replaced).

    Rows are never dropped; repeated rows and null urls stay as they are, extra columns too.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    found = judge_urls(pages, rules, default).withColumnRenamed("url", "_judged")
    hit = found.where(F.col("rule").isNotNull()).select("_judged", "rule", "verdict")
    out = pages.join(hit, pages["url"] == hit["_judged"], "left").drop("_judged")
    return out.select(
        *(out[c] for c in pages.columns),
        url_host(F.col("url")).alias("host"),
        url_path(F.col("url")).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
