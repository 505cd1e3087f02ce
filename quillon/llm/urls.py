"""URL filters: a sort-merge range join of page urls against prefix rules.

A host's labels reversed (``m.example.com`` -> ``com.example.m.``) make "this host
and its subdomains" a prefix, so a rule is an interval of canonical keys and the
intervals nest. Pages and rules are sorted together and swept once: the stack of
rules that are open at a key is the stack at the last rule start before it, less
those whose prefix the key has left. The same sweep over paths, within each host
that is open for a page, finds the rule with the longest path.

Pages are dealt to slices by row, so a hot host is spread evenly, and every slice
gets the rules. Rules beyond ``block_rules`` are swept in blocks and the longest
answer kept: a task's share is bounded for any rule set and none is dropped.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.staging import stage

BLOCK_RULES = 200_000
#: Host and path after the first ``://``; both empty where that is missing.
URL_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL_PATTERN, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PATTERN, 2), F.lit(""))


def canonical(host: Column) -> Column:
    """Reversed labels, each ended by a dot, so that prefixes end at labels."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _clean_rules(rules: DataFrame) -> DataFrame:
    """One verdict for each (host, path); where rules disagree, block wins."""
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    parts = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    merged = parts.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    return merged.select(canonical(F.col("host")).alias("node"), "host", "path", "verdict")


def _host_starts(rules: DataFrame) -> DataFrame:
    """Each rule host with the stack that is open where its interval starts."""
    nodes = rules.select("node").distinct()
    labels = F.split(F.expr("left(node, length(node) - 1)"), r"\.")
    depth = F.explode(F.sequence(F.lit(1), F.size(labels)))
    upward = nodes.select("node", labels.alias("labels"), depth.alias("depth"))
    prefix = F.concat(F.array_join(F.slice("labels", 1, F.col("depth")), "."), F.lit("."))
    upward = upward.select("node", prefix.alias("open"))
    open_nodes = upward.join(nodes.withColumnRenamed("node", "open"), "open")
    return open_nodes.groupBy("node").agg(F.collect_set("open").alias("stack"))


def _path_starts(rules: DataFrame) -> DataFrame:
    """Each rule with the rules of its host whose paths nest around its path."""
    cuts = F.explode(F.sequence(F.lit(0), F.length("path")))
    upward = rules.select("node", "path", cuts.alias("cut")).select("node", "path", F.expr("left(path, cut)").alias("open"))
    around = rules.select("node", F.col("path").alias("open"), "host", "verdict")
    nested = upward.join(around, ["node", "open"])
    entry = F.struct(F.length("open").alias("length"), F.col("open").alias("path"), "host", "verdict")
    return nested.groupBy("node", "path").agg(F.collect_list(entry).alias("stack"))


def _sweep(probes: DataFrame, starts: DataFrame, within: list[str], key: str, slices: int) -> DataFrame:
    """Probes with ``stack``: what is open at the last start before their key."""
    dealt = starts.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    rows = probes.withColumn("kind", F.lit(1)).unionByName(dealt.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("slice", *within).orderBy(key, "kind").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("stack", F.last("stack", ignorenulls=True).over(order)).filter("kind = 1").drop("kind")


def _best(pages: DataFrame, rules: DataFrame, slices: int) -> DataFrame:
    """Rows of ``pages`` with ``best``: the longest rule of one block that fits."""
    hosts = _sweep(pages, _host_starts(rules).withColumnRenamed("node", "key"), [], "key", slices)
    still_open = F.filter("stack", lambda s: F.startswith(F.col("key"), s))
    probes = hosts.withColumn("node", F.explode_outer(still_open)).drop("stack")
    paths = _sweep(probes, _path_starts(rules), ["node"], "path", slices)
    fits = F.filter("stack", lambda s: F.startswith(F.col("path"), s["path"]))
    longest = F.array_max(
        F.transform(
            fits,
            lambda s: F.struct(
                (F.length(s["host"]) + s["length"]).alias("length"),
                F.length(s["host"]).alias("host_length"),
                F.concat(s["host"], s["path"]).alias("rule"),
                s["verdict"].alias("verdict"),
            ),
        )
    )
    rows = paths.withColumn("best", longest)
    own = [F.first(c).alias(c) for c in ("page_id", "url", "host", "path", "key")]
    return rows.groupBy("slice", "row").agg(*own, F.max("best").alias("best"))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    default: str = "allow",
    block_rules: int = BLOCK_RULES,
    slices: int | None = None,
) -> DataFrame:
    """``page_id, url, host, path, rule, verdict`` for every row of ``pages``.

    ``rules`` has ``host, path, verdict``. A rule fits its host and the host's
    subdomains where the path starts with the rule's; the longest host and path
    together wins, the longer host among equals. Where none fits, ``rule`` is null and the verdict
    is ``default``. A null url, or one without ``://``, has empty host and path.
    Repeated rows each get a row, null ids too; a url of any length is read
    whole; other columns of ``pages`` are not read; an empty rule set leaves the
    default everywhere, an empty table gives no rows.
    """
    spark = pages.sparkSession
    slices = slices or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col(url_column).cast("string")
    rows = pages.select(F.col(id_column).alias("page_id"), url.alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "row": F.monotonically_increasing_id()})
    rows = stage(rows, "page-rows")  # numbered once, whatever is computed again
    rows = rows.withColumns({"key": canonical(F.col("host")), "slice": F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int")})
    clean = _clean_rules(rules)
    blocks = -(-clean.count() // block_rules)
    found = rows.withColumn("best", F.lit(None).cast("struct<length:int,host_length:int,rule:string,verdict:string>"))
    if blocks > 0:
        block = F.pmod(F.xxhash64("node", "path"), F.lit(blocks))
        parts = [_best(rows, clean.filter(block == k), slices) for k in range(blocks)]
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        if blocks > 1:
            own = [F.first(c).alias(c) for c in ("page_id", "url", "host", "path")]
            found = found.groupBy("slice", "row").agg(*own, F.max("best").alias("best"))
    verdict = F.coalesce(F.col("best.verdict"), F.lit(default))
    return found.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
