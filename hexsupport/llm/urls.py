"""URL filters: rules on hosts and path prefixes, matched by hashed expressions.

Each URL expands into expressions (host suffix + path prefix); a rule is such an
expression itself. They are equi-joined on a short hash prefix, a match is
confirmed by the full SHA-256, and the longest rule decides. Only built-in
functions run, and every distinct (host, path) is expanded once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hexsupport.llm.store import set_aside

#: Rules up to this number are broadcast (a few MB); more are joined by shuffling.
BROADCAST_RULES = 50_000

#: Parts into which the rows of one host and path are dealt.
SALTS = 16
RESULTS, INNER = ("host", "path", "rule", "verdict"), ("_host", "_path", "_salt")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ``://`` (A-Z lower-cased) and the path up to ``?`` or ``#``; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rules(spark: SparkSession, listed: list[tuple[str, str]]) -> DataFrame:
    """A rule table from (verdict, ``host/path``) pairs; the first slash begins the path."""
    rows = [(verdict, rule[: rule.index("/")], rule[rule.index("/") :]) for verdict, rule in listed]
    return spark.createDataFrame(rows, "verdict string, host string, path string")


def judge(pages: DataFrame, ruled: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``ruled(verdict, host, path)`` fits a host and its subdomains where the url's
    path starts with the rule's. The longest rule (host and path together) wins;
    of equal ones the longer host, of repeated ones ``block``. Defined results:
    null urls and urls without ``://`` have an empty host and path, which no rule
    fits; rules with a null or empty host fit nothing; urls that no rule fits
    have a null rule and the default verdict; input columns of the names of the
    results (in any case) are replaced, others pass through whatever their names;
    repeated rows are judged alike; urls of any length are judged whole; an empty
    rule table leaves the default everywhere; an empty table gives an empty one.
    """
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    pages = pages.select(*(F.col(f"`{c}`") for c in pages.columns if c.lower() not in RESULTS), host.alias("host"), path.alias("path"))
    rest = [c for c in pages.columns if c.lower() not in RESULTS]
    pages, renamed = set_aside(pages.select(*(F.col(f"`{c}`") for c in rest), "host", "path"), INNER)
    own = [renamed.get(c, c) for c in rest]
    kept = [F.col(f"`{c}`").alias(name) for c, name in zip(own, rest, strict=True)]

    ruled = ruled.filter("host <> '' AND verdict IS NOT NULL").select(
        "verdict", F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path")
    )
    ruled = ruled.groupBy("rule_host", "rule_path").agg(F.max(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("blocks"), F.max("verdict").alias("v"))
    ruled = ruled.select("rule_host", "rule_path", F.when(F.col("blocks") == 1, "block").otherwise(F.col("v")).alias("verdict"))
    bounds = ruled.agg(
        F.count("*").alias("n"),
        F.max(F.length("rule_path")).alias("path"),
        F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.collect_set(F.when(~F.col("rule_path").endswith("/"), F.length("rule_path"))).alias("cuts"),
    ).first()
    if not bounds.n:
        return pages.select(*kept, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    # no rule reaches beyond the longest rule path and the deepest rule host
    labels = F.split("host", r"\.")
    pages = pages.withColumn("_path", F.substr("path", F.lit(1), F.lit(bounds.path)))
    pages = pages.withColumn("_host", F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(bounds.labels)), F.lit(bounds.labels)), "."))
    keys = pages.filter("host <> ''").select("_host", "_path").distinct()
    tail, parts = F.split("_host", r"\."), F.split("_path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(tail)), lambda i: F.array_join(F.slice(tail, i, F.size(tail)), "."))
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when(i < F.size(parts), F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))).otherwise(F.col("_path")))
    cuts = F.filter(F.array(*(F.lit(n) for n in sorted(bounds.cuts))).cast("array<int>"), lambda n: n <= F.length("_path"))
    prefixes = F.array_distinct(F.concat(folders, F.transform(cuts, lambda n: F.substr("_path", F.lit(1), n))))

    def short(digest: Column) -> Column:
        return F.conv(F.substr(digest, F.lit(1), F.lit(8)), 16, 10).cast("long")

    opened = keys.select("_host", "_path", F.explode(suffixes).alias("suffix"))
    opened = opened.select("_host", "_path", "suffix", F.explode(prefixes).alias("prefix"))
    opened = opened.withColumn("digest", F.sha2(F.concat("suffix", F.lit("\n"), "prefix"), 256)).withColumn("key", short(F.col("digest"))).select("_host", "_path", "digest", "key")
    known = ruled.withColumn("rule_digest", F.sha2(F.concat("rule_host", F.lit("\n"), "rule_path"), 256)).withColumn("key", short(F.col("rule_digest")))
    known = F.broadcast(known) if bounds.n <= BROADCAST_RULES else known
    fits = opened.join(known, "key").filter("digest = rule_digest")
    rule = F.concat("rule_host", "rule_path")
    best = fits.groupBy("_host", "_path").agg(F.max(F.struct(F.length(rule).alias("size"), F.length("rule_host").alias("own"), rule.alias("rule"), "verdict")).alias("best"))
    best = best.select("_host", "_path", "best.rule", F.col("best.verdict").alias("verdict"))
    # a host may hold most urls: its verdicts are repeated for each salt
    best = best.withColumn("_salt", F.explode(F.array(*(F.lit(k) for k in range(SALTS)))))
    hashed = [f"`{c}`" for c in own if not any(x in pages.schema[c].dataType.simpleString() for x in ("map<", "variant"))]
    pages = pages.withColumn("_salt", F.pmod(F.xxhash64(*hashed, "path"), SALTS).cast("int"))
    judged = pages.join(best, ["_host", "_path", "_salt"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    return judged.select(*kept, "host", "path", "rule", "verdict")
