"""URL filters by a sort-merge range join.

A rule's key is its host reversed by labels, then its path. Written so, a rule covers the
interval of keys that begin with its own. A URL is looked up once for each suffix of its
host, so a rule on a host also meets its subdomains. Rule boundaries and URL keys are range
partitioned and sorted together; the sweep carries the top of the stack of open rules, and
a rule that closes uncovers the rule around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, written

# Fixed values: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: For URLs that no rule fits.
DEFAULT_VERDICT = "allow"
#: Rows of the sorted sweep in one partition, about.
SWEEP_ROWS = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first "://": the host up to "/", "?", "#" or the end, A-Z lower-cased; the path up to "?", "#" or the end. Both empty for null or without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def _key(labels: Column, path: Column) -> Column:
    """Bytes: they sort and compare unsigned, so that 0xFF ends every interval. A label ends with 0x00, the host with 0x01: no host's key begins another host's."""
    return F.encode(F.concat(F.array_join(labels, "\u0000"), F.lit("\u0000\u0001"), path), "utf-8")


def url_filters(pages: DataFrame, rules: DataFrame | None = None, default_verdict: str = DEFAULT_VERDICT) -> DataFrame:
    """One row for each row of pages (page_id, url; other columns are ignored).

    Columns: page_id, host, path, rule (host and path of the longest rule that fits, else
    null), verdict. rules: (verdict, host, path), a table of any size; of equal host and path,
    block wins; null fields count as empty; of rules equally long the one on the longer host
    wins. A null URL or one without "://" has an empty host, which no rule fits. Repeated rows
    and ids each get their own row; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    if rules is None:
        rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    urls = written(urls, "urls")  # the row numbers hold from here on

    rules = rules.select(F.coalesce("verdict", F.lit("block")).alias("verdict"), ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).filter("host <> ''")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumn("low", _key(F.reverse(F.split("host", r"\.")), F.col("path"))).withColumn("rule", F.struct(F.concat("host", "path").alias("name"), "verdict", F.length("host").alias("on_host"), F.octet_length("low").alias("size")))
    # What a closing rule uncovers: the longest rule whose key is a proper prefix of its own.
    above = rules.select("low", F.explode(F.expr("transform(sequence(1, octet_length(low)), n -> substring(low, 1, n - 1))")).alias("prefix"))
    around = above.join(rules.select(F.col("low").alias("prefix"), F.col("rule").alias("outer")), "prefix").groupBy("low").agg(F.max_by("outer", "outer.size").alias("outer"))
    rules = rules.join(around, "low", "left")
    row_type = "struct<name:string,verdict:string,on_host:int,size:int>"
    opens = rules.select(F.col("low").alias("key"), F.col("rule.size").alias("turn"), F.lit(None).cast("long").alias("row"), F.lit(True).alias("bound"), F.col("rule").cast(row_type).alias("top"))
    # Of intervals that end together the inner one closes first; closing sorts after every key inside.
    closes = rules.select(F.concat("low", F.lit(b"\xff")).alias("key"), (-F.col("rule.size")).alias("turn"), F.lit(None).cast("long").alias("row"), F.lit(True).alias("bound"), F.col("outer").cast(row_type).alias("top"))
    labels = F.reverse(F.split("host", r"\."))
    looked_up = urls.filter("host <> ''").select("row", "path", labels.alias("labels")).select("row", "path", F.explode(F.expr("transform(sequence(1, size(labels)), n -> slice(labels, 1, n))")).alias("labels"))
    keys = looked_up.select(_key(F.col("labels"), F.col("path")).alias("key"), F.lit(2**31 - 1).alias("turn"), "row", F.lit(False).alias("bound"), F.lit(None).cast(row_type).alias("top"))

    # The row number in the range keys splits a key that very many URLs share.
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + urls.count() // SWEEP_ROWS)
    swept = opens.unionByName(closes).unionByName(keys).repartitionByRange(n, "key", "turn", "row").withColumn("part", F.spark_partition_id())
    swept = written(swept, "url-sweep")
    order = ("key", "turn", "row")
    # A partition starts with the stack that the partitions before it leave: a row each.
    ends = swept.groupBy("part").agg(F.max_by(F.struct("top"), F.when(F.col("bound"), F.struct(*order))).alias("end"))
    start = ends.select("part", F.last("end", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))["top"].alias("start"))
    sweep = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(F.col("bound"), F.struct("top")), ignorenulls=True).over(sweep)
    active = swept.withColumn("state", state).filter(~F.col("bound")).join(F.broadcast(start), "part").select("row", F.when(F.col("state").isNotNull(), F.col("state.top")).otherwise(F.col("start")).alias("rule"))
    best = active.filter(F.col("rule").isNotNull()).groupBy("row").agg(F.max(F.struct(F.length("rule.name").alias("n"), "rule.on_host", F.col("rule.name").alias("rule"), "rule.verdict")).alias("best"))
    return urls.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default_verdict)).alias("verdict"))
