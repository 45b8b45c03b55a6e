"""URL filters: rules as intervals of sorted canonical keys, swept with the stack of open nested rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtally.llm.common import free_name
from flowtally.operators.sized import small_side

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sorts after every text that goes on behind a prefix.
LAST = "\U0010ffff"
#: Rows that one sweep sorts; a host with more is swept in several hashed strips.
STRIP_ROWS = 50_000


def url_host(url: Column) -> Column:
    """Host of a url: behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def boundaries(rules: DataFrame) -> DataFrame:
    """Where the sweep changes: rhost, key, turn (0 closes, 1 opens) and top, the innermost rule from there on.

    ``rules``: host, path, verdict. The rules of a host are nested intervals of paths: [path, path + last
    character). Opening one puts it on the stack; closing it puts back the rule of the longest proper prefix,
    which an equi-join on the prefixes finds. Equal rules keep the verdict that sorts first; rules without a
    host or path are left out, since they name nothing.
    """
    clean = (rules.where("host IS NOT NULL AND path IS NOT NULL AND host <> ''")
             .groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.min("verdict").alias("verdict")))
    rule = F.struct(F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_length"))
    clean = clean.select(reversed_host(F.col("host")).alias("rhost"), "path", rule.alias("own"))
    prefixes = (clean.where("path <> ''").select("rhost", F.col("path").alias("inner"), F.explode(F.sequence(F.lit(0), F.length("path") - 1)).alias("n"))
                .select("rhost", "inner", F.expr("left(inner, n)").alias("path")))
    parents = (prefixes.join(clean, ["rhost", "path"])
               .groupBy("rhost", F.col("inner").alias("path")).agg(F.max_by("own", F.length("path")).alias("parent")))
    nested = clean.join(parents, ["rhost", "path"], "left")
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(None).cast("int").alias("host_length"))
    opens = nested.select("rhost", F.col("path").alias("key"), F.lit(1).alias("turn"), F.col("own").alias("top"))
    closes = nested.select("rhost", F.concat("path", F.lit(LAST)).alias("key"), F.lit(0).alias("turn"), F.coalesce("parent", none).alias("top"))
    return opens.unionByName(closes)


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", strip_rows: int = STRIP_ROWS) -> DataFrame:
    """All columns of ``pages`` with host, path, rule and verdict of its url in a struct column ``judged``.

    A rule fits its host and all subdomains when the url's path starts with the rule's; the longest wins
    (equal lengths: the longer host). Each url stands under the reversed name of its host and of every parent
    domain that has a rule; per such name the paths and the rules' ends are sorted and one running value
    carries the innermost open rule. A name with many urls is swept in several strips, each with all its
    rules. Null urls and urls without ``://`` have an empty host and path and get ``default``. Equal urls are judged once.
    """
    edges = boundaries(rules)
    urls = pages.select(F.col(url_col).alias("url")).distinct().select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.reverse(F.slice(labels, -n, n)), "."))
    named = urls.where("host <> ''").select("url", F.explode(parents).alias("rhost"), F.col("path").alias("key"))
    ruled, _ = small_side(edges.select("rhost").distinct())
    named = named.join(ruled, "rhost", "left_semi")
    strips = named.groupBy("rhost").agg(F.ceil(F.count("*") / F.lit(strip_rows)).cast("int").alias("strips"))
    strips, _ = small_side(strips)
    points = (named.join(strips, "rhost")
              .select("rhost", F.pmod(F.xxhash64("url"), F.col("strips")).cast("int").alias("strip"), "key", F.lit(2).alias("turn"), "url",
                      F.lit(None).cast(edges.schema["top"].dataType).alias("top")))
    marks = (edges.join(strips, "rhost")
             .select("rhost", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)).alias("strip"), "key", "turn", F.lit(None).cast("string").alias("url"), "top"))
    sweep = Window.partitionBy("rhost", "strip").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, 0)
    found = (points.unionByName(marks).withColumn("top", F.last("top", ignorenulls=True).over(sweep))
             .where("turn = 2 AND top.rule IS NOT NULL")
             .groupBy("url").agg(F.max(F.struct(F.length("top.rule").alias("length"), "top.host_length", "top.rule", "top.verdict")).alias("best"))
             .withColumnRenamed("url", "u"))
    judged = (urls.join(found, F.col("url") == F.col("u"), "left")
              .select(F.struct("url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")).alias(j := free_name(pages, "judged"))))
    return pages.join(judged, pages[url_col].eqNullSafe(F.col(f"{j}.url")), "left").withColumn(j, F.col(j).dropFields("url"))
