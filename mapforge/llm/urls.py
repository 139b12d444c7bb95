"""URL rules by a sort-merge range join, in DataFrame operations only.

A rule is a host and a path prefix; it holds for its host and all subdomains. With the host's labels reversed, a
rule is an interval of keys: all that begin with "com.example//en/", the path with a slash before
it, which no host contains. Intervals of prefixes are nested or disjoint.
A url asks once for each of its host's suffixes (as many labels as rules have at most), with the key of suffix and
path; the longest rule found for any of them wins.

One sorted sweep over interval ends and questions finds for each question the innermost open rule. The stack of open
rules is a table by depth: a running count of begun less ended rules is the depth, and the top of the stack after a
rule ends is the last rule that began at the depth below. So each event knows the rule that is open after it, and a
question takes that of the last event before it.

A key's host is compared whole, so rules nest within one host only, and each rule host is swept by itself: urls whose
suffixes have no rule are asked nothing. The questions of a host with many are dealt over salts in proportion to its
share of all, with that host's own events repeated for each. A task holds the events of one rule host, and a part of the
questions; only a single host's rules are never split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import apart, ascii_lower, column_names, partitions, saved

#: Sorts behind every continuation of a prefix: no character of a url is beyond it.
_AFTER = "\U0010ffff"
_LAST = Window.unboundedPreceding


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no "://"."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def reversed_host(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def _events(rules: DataFrame) -> DataFrame:
    """(zone, key, kind, open): begin (kind 0) and end (kind 2) of each rule, and the rule that is open after it."""
    labels = F.split("host", r"\.")
    begin = F.concat(reversed_host(labels), F.lit("/"), F.col("path"))
    r = rules.select(F.col("rule"), F.col("action"), begin.alias("low"), F.struct("rule", "action", F.size(labels).alias("labels"), F.length("rule").alias("length")).alias("own"))
    # Equal prefixes are one rule; of those, block wins, so that the result does not depend on their order.
    r = r.groupBy("low").agg(F.max_by("own", "action").alias("own"))
    ends = r.select(F.col("low").alias("key"), F.lit(0).alias("kind"), F.lit(1).alias("step"), "own").union(
        r.select(F.concat("low", F.lit(_AFTER)).alias("key"), F.lit(2), F.lit(-1), "own")
    )
    # What is under one host nests apart from the rest.
    top = ends.withColumn("zone", F.substring_index("key", "/", 1))
    swept = top.withColumn("depth", F.sum("step").over(Window.partitionBy("zone").orderBy("key", "kind").rowsBetween(_LAST, 0)))
    # A slot of the stack: begins at depth d, and ends that come back to it.
    slot = Window.partitionBy("zone", "depth").orderBy("key", "kind").rowsBetween(_LAST, 0)
    return swept.withColumn("open", F.when(F.col("depth") > 0, F.last(F.when(F.col("step") == 1, F.col("own")), ignorenulls=True).over(slot))).select("zone", "key", "kind", "open")


def url_verdicts(pages: DataFrame, rules: DataFrame, default: str = "allow", salts: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each row of pages.

    rules has host, path and action (allow or block), and a path begins with "/". The longest fitting rule decides;
    rule is its host and path, or null, where the verdict is the default. A null url, or one without "://", has an
    empty host and path and fits no rule. Rows that repeat a page_id, or have none, are judged each by itself. Rules
    with a null part are left out; no rules give every page the default. Further columns are ignored.
    """
    spark = pages.sparkSession
    salts = salts or partitions(spark)
    known = rules.select(ascii_lower(F.col("host")).alias("host"), "path", "action").filter("host is not null and path is not null and action is not null").withColumn("rule", F.concat("host", "path"))
    deepest = known.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first()[0] or 0
    host, path = url_parts(F.col("url"))
    # A row's own number keeps rows apart that repeat a page_id; it must be the same each time, so the rows are written.
    read = column_names(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    asked = saved(read.withColumn("row", F.monotonically_increasing_id()), "asked")
    labels = F.split("host", r"\.")
    suffixes = F.when(F.col("host") == "", F.array()).otherwise(F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(deepest, 1)))), lambda n: F.slice(labels, -n, n)))
    questions = asked.select("row", "path", F.explode(suffixes).alias("suffix")).select("row", "path", reversed_host(F.col("suffix")).alias("zone"))

    events = _events(known)
    zones = events.select("zone").distinct()
    counts = questions.join(zones, "zone").groupBy("zone").agg(F.count("*").alias("n"))
    counts = apart(counts, "zones")
    total = counts.agg(F.sum("n")).first()[0] or 0
    dealt = counts.select("zone", F.ceil(F.col("n") * salts / max(total, 1)).cast("int").alias("salts"))
    ask = questions.join(dealt, "zone").select("zone", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int").alias("salt"), F.concat("zone", F.lit("/"), F.col("path")).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("struct<rule:string,action:string,labels:int,length:int>").alias("open"), "row")
    tell = events.join(dealt, "zone").select("zone", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "key", "kind", "open", F.lit(None).cast("long").alias("row"))
    # An event that leaves no rule open still counts, so it is wrapped in a struct of its own.
    sweep = Window.partitionBy("zone", "salt").orderBy("key", "kind").rowsBetween(_LAST, 0)
    both = ask.union(tell).withColumn("event", F.when(F.col("kind") != 1, F.struct("open")))
    found = both.withColumn("last", F.last("event", ignorenulls=True).over(sweep)).filter("kind = 1 and last.open is not null").select("row", F.col("last.open").alias("rule"))
    best = found.groupBy("row").agg(F.max(F.struct("rule.length", "rule.labels", "rule.rule", "rule.action")).alias("best"))
    won = asked.join(best, "row", "left")
    return won.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
