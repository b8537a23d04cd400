"""URL rules by a sort-merge range join.

A rule (host, path) covers its host, all subdomains, and paths that start with its own. Written as
reversed host + separator + path, a rule is a prefix of what it covers, so it is an interval of the
sorted keys, and intervals of prefixes are nested or disjoint. A URL is looked up under each of its
host's suffixes, as long as rules' hosts have so many labels.

The sweep: rules and URL keys are sorted together and each key sees the last rule at or before it.
That rule carries the stack of rules that enclose it; whatever covers the key is on that stack (a
prefix of the key that sorts before the last rule encloses that rule too), so the innermost that is
a prefix of the key is the answer.

Rows are dealt to sweeps by a range of the rules' keys and a salt of the URL, so a host with a third
of all URLs is spread out. Each range has as many salts as its own keys need, and only its own rules
are repeated, once per salt: with rules spread over ranges, repeated rules grow with the keys, not with
keys times rules. Each range starts with the last rule before it. Equal URLs are judged once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.llm.common import documents, free_name

#: Keys for each sweep that shares a range of rules, such sweeps of a range at most, and rules a range aims at.
PAGES_PER_SALT, SALTS = 50_000, 20_000
RULES_PER_RANGE = 50_000
SEP = "\u0001"  # below every character of a host, and at its end in a key


def split_url(url):
    """(host, path) columns: host from after the first :// up to / ? # or the end, A-Z lowered; path
    from there up to ? # or the end. Both empty for a null or a URL without ://."""
    found = F.instr(url, "://") > 0
    rest = F.substring_index(F.substring_index(F.when(found, F.substring(url, F.instr(url, "://") + 3, F.length(url))), "?", 1), "#", 1)
    raw = F.substring_index(rest, "/", 1)
    path = F.substring(rest, F.length(raw) + 1, F.length(rest))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(raw, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def _labels(host):
    """Labels, top domain first, and nothing for an empty host."""
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.reverse(F.split(host, "\\.")))


def _key(labels, path):
    return F.concat(F.array_join(labels, "."), F.lit(SEP), path)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All rows and columns of pages, with a struct column judged: host, path, rule, verdict. A column of pages of that name is replaced.

    rules: host, path, verdict (strings). Of the rules that cover a URL the one with the longest host
    wins, then the one with the longest path; of equal rules the least verdict. Rules with a null
    are ignored. URLs that no rule covers get a null rule and the default verdict.
    """
    spark = pages.sparkSession
    r = (
        rules.where("host is not null and path is not null and verdict is not null")
        .groupBy("host", "path")
        .agg(F.min("verdict").alias("verdict"))
        .select(_key(_labels(F.col("host")), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict", F.size(_labels(F.col("host"))).alias("depth"))
    )
    # The stack of a rule: rules that are proper prefixes of its key, outermost first.
    ends = r.select("key", F.explode(F.sequence(F.lit(1), F.length("key"))).alias("n")).select("key", F.substring("key", F.lit(1), F.col("n")).alias("outer"))
    stacks = (
        ends.join(r.select(F.col("key").alias("outer"), "rule", "verdict"), "outer")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct(F.length("outer").alias("n"), "outer", "rule", "verdict"))).alias("stack"))
    )
    n_rules, most = r.agg(F.count(F.lit(1)), F.max("depth")).first()
    most = most or 0
    # Bounds of the ranges: a sample of rules, taken by hash, of a few for each range.
    ranges = min(200, 1 + n_rules // RULES_PER_RANGE)
    sample = sorted(x[0] for x in r.select("key").orderBy(F.xxhash64("key"), "key").limit(20 * (ranges - 1)).collect()) if ranges > 1 else []
    bounds = F.array(*[F.lit(x) for x in sample[10::20]]) if sample else F.array().cast("array<string>")
    range_of = lambda k: F.size(F.filter(bounds, lambda b: b <= k))

    host, path = split_url(F.col("_url"))
    urls = pages.select(F.col(url).alias("_url")).where(F.col(url).contains("://")).distinct()
    keys = (
        urls.select("_url", host.alias("_host"), path.alias("_path"))
        .select("_url", "_path", F.slice(_labels(F.col("_host")), 1, max(most, 1)).alias("_labels"))
        .where(F.size("_labels") > 0)  # sequence(1, 0) would count down
        .select("_url", "_path", "_labels", F.explode(F.expr("sequence(1, size(_labels))")).alias("depth"))
        .select("_url", "depth", _key(F.slice("_labels", F.lit(1), F.col("depth")), F.col("_path")).alias("key"))
    )
    keys = keys.withColumn("_range", range_of(F.col("key")))
    # Keys of each range, 200 numbers at most; with one range the pages say enough.
    counts = dict(keys.groupBy("_range").count().collect()) if ranges > 1 else {0: pages.count()}
    salts = F.array(*[F.lit(max(1, min(SALTS, counts.get(i, 0) // PAGES_PER_SALT))).cast("long") for i in range(ranges)])
    salts_of = lambda r: F.get(salts, r)
    keys = keys.withColumn("_salt", F.pmod(F.xxhash64("_url"), salts_of(F.col("_range"))))

    ruled = stacks.withColumn("_range", range_of(F.col("key")))
    # A range's first rows may lie in a rule before it: the last rule of the ranges before, for each range.
    lasts = ruled.groupBy("_range").agg(F.max_by("stack", "key").alias("stack"), F.max("key").alias("key"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    all_ranges = spark.range(ranges).select(F.col("id").cast("int").alias("_range"))  # 200 rows at most
    carried = (
        all_ranges.join(lasts, "_range", "left")
        .select("_range", F.last("stack", True).over(before).alias("stack"))
        .where("stack is not null")
        .select(F.lit("").alias("key"), "stack", "_range")
    )
    events = (
        ruled.select("key", "stack", "_range")
        .union(carried)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts_of(F.col("_range")) - 1)))
        .select("_range", "_salt", "key", "stack", F.lit(None).cast("string").alias("_url"), F.lit(0).alias("depth"))
        .union(keys.select("_range", "_salt", "key", F.lit(None).cast(stacks.schema["stack"].dataType), "_url", "depth"))
    )
    # At equal keys the rule comes first (its _url is null).
    sweep = W.partitionBy("_range", "_salt").orderBy("key", F.col("_url").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    found = (
        events.withColumn("open", F.last("stack", True).over(sweep))
        .where("_url is not null and open is not null")
        .withColumn("inner", F.try_element_at(F.filter("open", lambda x: F.col("key").startswith(x["outer"])), F.lit(-1)))
        .where("inner is not null")
        .groupBy("_url")
        .agg(F.max(F.struct("depth", F.col("inner.n").alias("n"), F.col("inner.rule").alias("rule"), F.col("inner.verdict").alias("verdict"))).alias("_best"))
    )
    key, best = free_name(pages, "judged_url"), free_name(pages, "judged_best")
    p_host, p_path = split_url(F.col(url))
    judged = F.struct(
        p_host.alias("host"), p_path.alias("path"), F.col(f"{best}.rule").alias("rule"), F.coalesce(f"{best}.verdict", F.lit(default)).alias("verdict")
    )
    found = found.select(F.col("_url").alias(key), F.col("_best").alias(best))
    return pages.join(found, F.col(url) == F.col(key), "left").withColumn("judged", judged).drop(key, best)


#: The fixed rules of the query: host, path, verdict.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(pages, rules).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


OP5_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), s AS (
  SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw, coalesce(regexp_extract(rest, '^[^?#]*'), '') AS hp FROM u
), h AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(hp, length(raw) + 1) AS path FROM s
), rules(rh, rp, verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), n AS (SELECT row_number() OVER () AS rid, * FROM h),
m AS (
  SELECT rid, arg_max(rh || rp, length(rh) * 100000 + length(rp)) AS rule, arg_max(verdict, length(rh) * 100000 + length(rp)) AS verdict
  FROM n JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM n LEFT JOIN m USING (rid)
"""
