"""Operator 1: URL filters by host-suffix and path-prefix expressions (DataFrame functions only).

Each distinct (host, path) is expanded into the expressions host suffix + path prefix whose shape
(number of labels, path length) some rule has, so a long path costs no more than a short one. The
expressions meet the rules in an equi-join on the first ``PREFIX_HEX`` hex digits of their SHA-256;
the full digests then confirm the match, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickcast.llm.common import ascii_lower

PREFIX_HEX = 8
DEFAULT_VERDICT = "allow"

#: The rules of the registered query.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as a table (rule, verdict)."""
    values = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in rules))
    return spark.range(1).select(F.inline(values))


def url_host(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def url_path(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Host, path, shape and digest of each rule. The host ends at the first ``/``; rules that are
    null or have no host match nothing; of equal rules with both verdicts, ``block`` stays."""
    cut = F.instr("rule", "/")
    host = F.when(cut > 0, F.substring("rule", F.lit(1), cut - 1)).otherwise(F.col("rule"))
    return (
        rules.groupBy("rule").agg(F.max("verdict").alias("rule_verdict"))  # 'block' > 'allow'
        .withColumn("rule_host", ascii_lower(host))
        .filter("rule_host <> ''")
        .withColumn("rule_path", F.when(cut > 0, F.substring("rule", cut, F.length("rule"))).otherwise(""))
        .select(
            "rule", "rule_verdict",
            F.size(F.split("rule_host", "\\.", -1)).alias("labels"),
            F.length("rule_path").alias("path_len"),
            F.length("rule_host").alias("host_len"),
            F.sha2(F.concat("rule_host", "rule_path"), 256).alias("rule_digest"),
        )
        .withColumn("prefix", F.substring("rule_digest", 1, PREFIX_HEX))
    )


def expressions(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path) -> one row per expression digest, for the shapes that rules have. Their list is
    bounded by (labels of a rule's host) x (length of a rule's path), whatever the number of rules."""
    shapes = rules.agg(F.collect_set(F.struct("labels", "path_len")).alias("s"))
    n_labels = F.size(F.split("host", "\\.", -1))
    fits = F.filter("shapes", lambda s: (s["labels"] <= n_labels) & (s["path_len"] <= F.length("path")))
    made = F.transform(fits, lambda s: F.concat(
        F.element_at(F.col("suffixes"), s["labels"]), F.col("path").substr(F.lit(1), s["path_len"])))
    deepest = rules.agg(F.max("labels").alias("m"))
    parts = F.reverse(F.split("host", "\\.", -1))
    suffixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n_labels, F.col("deepest")))),
        lambda k: F.array_join(F.reverse(F.slice(parts, F.lit(1), k)), "."))
    return (
        urls.withColumn("shapes", shapes.scalar()).withColumn("deepest", F.coalesce(deepest.scalar(), F.lit(1)))
        .withColumn("suffixes", suffixes)
        .select("host", "path", F.explode(made).alias("expression"))
        .select("host", "path", F.sha2("expression", 256).alias("digest"))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``pages`` -> (id, host, path, rule, verdict), one row per input row.

    A null url, or one without ``://``, has an empty host and path and gets ``default``, as every url
    does that no rule fits. Of the fitting rules the longest rule string wins, then the longer host,
    then the greater string. Repeated pages each get a row; other columns are not read. No rules, or
    no pages: every page gets the default, or an empty result.
    """
    rules = prepared_rules(rules)
    split = pages.select(F.col(id_col).alias(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    urls = split.select("host", "path").distinct()  # a page repeated a million times is judged once
    best = F.max(F.struct(F.length("rule"), "host_len", "rule", "rule_verdict")).alias("best")
    judged = (
        expressions(urls, rules).join(rules, "prefix").filter("digest = rule_digest")
        .groupBy("host", "path").agg(best)
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("found"))
    )
    return split.join(judged, ["host", "path"], "left").select(
        id_col, "host", "path", "rule", F.coalesce("found", F.lit(default)).alias("verdict"))
