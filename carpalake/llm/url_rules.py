"""URL filter: longest matching (host, path prefix) rule for every url, as a sort-merge range join.

A rule is one interval of canonical keys. The key of a rule is its host with the labels
reversed, a NUL, and its path; every key that starts with it lies in [key, key + 0xFF), as
0xFF never occurs in UTF-8. Intervals of prefixes nest or are disjoint. A url gives one key
for each suffix of its host that is as long as some rule's host, so that subdomains fall into
the interval of their parent's rule.

Keys and interval ends are sorted together into ranges of about equal size and swept, with a stack of the
rules that are open: an opening end puts its rule one place higher, a closing end takes the highest away, and a
url's key sees the highest. Place d of the stack is the last rule opened at depth d, and the depth is a
running sum, so both are windows over a range. What a range finds open at its start is the sum and the last
rules of the ranges before it: a table of one row for each range and depth. So neither rules nor urls are
copied, and keys of a hot host, even one key, spread over ranges. Only built-in functions are used.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, parallelism


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _key(labels: Column, path: Column) -> Column:
    """labels: of the host, last one first."""
    return F.encode(F.concat(F.array_join(labels, "."), F.lit("\0"), path), "UTF-8")


def _ends(rules: DataFrame) -> DataFrame:
    """The two ends of each rule's interval: step 1 opens it, step -1 closes it."""
    key = _key(F.reverse(F.split("host", r"\.")), F.col("path"))
    rule = F.struct(F.length(F.concat("host", "path")).alias("size"), F.concat("host", "path").alias("rule"), "verdict")
    opens = F.struct(key.alias("key"), F.lit(1).alias("step"), rule.alias("rule"))
    closes = F.struct(F.concat(key, F.unhex(F.lit("FF"))).alias("key"), F.lit(-1).alias("step"), F.lit(None).cast("struct<size: int, rule: string, verdict: string>").alias("rule"))
    return rules.select(F.explode(F.array(opens, closes)).alias("end")).select("end.key", "end.step", "end.rule")


def _swept(events: DataFrame) -> DataFrame:
    """The rows of events with step 0, with the rule on top of the stack (active). events: range, key, step, rule, mix and others."""
    order = ["key", F.abs(F.col("step")).desc(), "mix"]  # ends before urls with the same key
    steps = events.groupBy("range").agg(F.sum("step").alias("sum"))
    base = steps.select("range", F.coalesce(F.sum("sum").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # a row for each range
    inside = F.sum("step").over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = events.join(F.broadcast(base), "range").withColumn("depth", F.col("base") + inside).drop("base")
    opened = placed.withColumn("opened", F.when(F.col("step") == 1, F.col("rule"))).filter("step >= 0")
    last = opened.groupBy("range", "depth").agg(F.max_by("opened", F.when(F.col("opened").isNotNull(), F.col("key"))).alias("last"))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("depth").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select("range", "depth", before.alias("carried"))  # a row for each range and depth in it
    own = F.last("opened", ignorenulls=True).over(Window.partitionBy("range", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    tops = opened.withColumn("own", own).filter("step = 0").join(carried, ["range", "depth"])
    return tops.withColumn("active", F.when(F.col("depth") > 0, F.coalesce("own", "carried")))


def judge_urls(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url", ranges: int | None = None) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule (host and path of the longest rule that fits, or null), verdict (the rule's, else default).

    rules: (verdict, host, path) rows. A rule fits its host and all subdomains if the url's path
    starts with its path. "Longest" counts the characters of host and path together; of two
    rules as long, the later in code-point order wins; of a rule given twice with both verdicts, block. Rules
    with a null host or path don't count.
    Cases: a null url or one without "://" has an empty host and path and gets the default unless a
    rule with an empty host fits; null ids and repeated rows each keep their row; an empty table
    gives no rows; other columns of pages are not read.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "verdict string, host string, path string")
    rules = rules.filter("host IS NOT NULL AND path IS NOT NULL").groupBy(ascii_lower(F.col("host")).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0

    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).groupBy("id", "url").agg(F.count(F.lit(1)).alias("rows"))
    urls = urls.select("id", "url", "rows", host.alias("host"), path.alias("path"))
    labels = F.slice(F.reverse(F.split("host", r"\.")), 1, max(deepest, 1))
    points = (
        urls.withColumn("labels", labels)
        .withColumn("own", F.explode(F.sequence(F.lit(1), F.size("labels"))))
        .select(_key(F.slice("labels", F.lit(1), F.col("own")), F.col("path")).alias("key"), F.lit(0).alias("step"), F.xxhash64("id", "url").alias("mix"), "id", "url", "rows", "host", "path")
    )
    events = points.unionByName(_ends(rules).withColumn("mix", F.lit(0).cast("long")), allowMissingColumns=True)
    events = events.repartitionByRange(ranges or parallelism(spark), "key", F.abs(F.col("step")).desc(), "mix").withColumn("range", F.spark_partition_id())
    swept = _swept(Scratch(spark, "ranges").keep(events, "events"))  # a range keeps its rows however often they are read
    best = swept.groupBy("id", "url", "host", "path", "rows").agg(F.max("active").alias("best"))
    return best.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
