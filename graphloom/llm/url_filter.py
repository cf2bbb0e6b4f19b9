"""URL filter: host-suffix and path-prefix expressions joined to rules on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules up to this many are sent to every executor; more are joined by shuffle.
BROADCAST_RULES = 100_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL: the host lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, the path from there to the next ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, allow: list[str], block: list[str]) -> DataFrame:
    """Rules ``rule, verdict, tier`` from strings like ``example.org/es/``."""
    rows = [*((r, "allow") for r in allow), *((r, "block") for r in block)]
    if not rows:
        return spark.sql("SELECT '' AS rule, '' AS verdict WHERE false")
    names = {f"r{i}": r for i, (r, _) in enumerate(rows)}
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"(:r{i}, '{v}')" for i, (_, v) in enumerate(rows)) + " AS t(rule, verdict)", args=names)


def _keyed(rules: DataFrame, tier: int) -> DataFrame:
    cut = F.instr("rule", "/")
    return rules.where("rule IS NOT NULL").select(
        F.col("rule"),
        F.col("verdict").alias("rule_verdict"),
        F.lit(tier).alias("tier"),
        F.length("rule").alias("rule_length"),
        F.length(F.when(cut > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise("")).alias("path_length"),
        F.sha2("rule", 256).alias("digest"),
    ).withColumn("short", F.substring("digest", 1, 8))


def filter_urls(pages: DataFrame, rules: DataFrame, method_rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, method_rule``.

    A rule ``host/path`` fits its host and all subdomains if the URL's path
    starts with the rule's; the longest rule wins, then the lexically least. ``rule`` is
    null if none of ``rules`` fits; then ``method_rules`` decide in the same way, then
    ``default``. Null URLs and URLs without ``://`` have an empty host and path
    and fit no rule. Repeated pages each get their row; empty tables are
    fine; extra columns are ignored. A rule with an empty host fits nothing.

    Each URL is expanded into its host suffixes, by label, times the path
    lengths that rules have. SHA-256 prefixes of 8 hex digits are
    joined and full digests confirm. Expansion, join and choice work on the
    distinct pairs of host and path, so a hot host costs one row a path.
    """
    spark = pages.sparkSession
    keyed = _keyed(rules, 0)
    if method_rules is not None:
        keyed = keyed.unionByName(_keyed(method_rules, 1))
    lengths = sorted(r[0] for r in keyed.select("path_length").distinct().collect())
    host, path = url_parts(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not lengths:
        return split.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default), "method_rule": F.lit(None).cast("string")})
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    urls = split.select("host", "path").where("host <> ''").distinct()
    wide = urls.select("host", "path", F.explode(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))).alias("expression"))
    wide = wide.withColumn("full", F.sha2("expression", 256)).withColumn("start", F.substring("full", 1, 8))
    few = keyed.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    hits = wide.join(F.broadcast(keyed) if few else keyed, (F.col("start") == F.col("short"))).where(
        (F.col("full") == F.col("digest")) & (F.col("expression") == F.col("rule"))
    )
    best = lambda tier, what: F.min_by(F.when(F.col("tier") == tier, F.col(what)), F.when(F.col("tier") == tier, F.struct(-F.col("rule_length"), F.col("rule"))))
    chosen = hits.groupBy("host", "path").agg(
        best(0, "rule").alias("rule"), best(0, "rule_verdict").alias("own"), best(1, "rule").alias("method_rule"), best(1, "rule_verdict").alias("method")
    )
    return (
        split.join(chosen, ["host", "path"], "left")
        .select("page_id", "host", "path", "rule", F.coalesce("own", "method", F.lit(default)).alias("verdict"), "method_rule")
    )
