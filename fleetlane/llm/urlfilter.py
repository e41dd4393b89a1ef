"""URL filters from dated lists.

Lists are histories of entries: at a time, a list adds or removes a rule.
A rule is a host suffix (``example.org``) or a URL prefix by whole path
segments (``example.org/a``).  The entries of a list and rule become
validity intervals (each lasts to the rule's next entry), and every capture
is evaluated against the entries in force when it was fetched.

Captures that share rule candidate and fetch time are evaluated once, so a
host with a third of all captures is pre-aggregated before the shuffle;
intervals and fetch times meet by rule and time bucket, so a rule with a
long history or many captures is spread over its buckets.

Edge cases: a null or unusable URL and a null fetch time match no rule;
entries with a null list, rule, time or action are ignored, and those whose
action is neither add nor remove (in any case); rules may be written in any
case, with a final dot or slash; of entries of a list, rule and time, a
removal wins; an entry's own time is inside its
interval, the next entry's is not; repeated captures get the same answer;
empty tables match nothing.  Columns of captures other than id, url and
time are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class UrlFilterParams:
    bucket_seconds: int = 32 * 86400


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dots; '' if there is
    none."""
    h = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(h), r"\.+$", "")


def path(url: Column) -> Column:
    """Path before query and fragment, without its slashes at the ends."""
    p = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([^?#]*)", 1)
    return F.regexp_replace(p, r"^/+|/+$", "")


def candidates(url: Column) -> Column:
    """All rules that could match: host suffixes, and the full host with
    every leading run of path segments."""
    parts = F.split(host(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)),
                           lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))
    seg = F.filter(F.split(path(url), "/+"), lambda s: s != "")
    prefixes = F.transform(F.when(F.size(seg) > 0, F.sequence(F.lit(1), F.size(seg))).otherwise(F.array()),
                           lambda i: F.concat(host(url), F.lit("/"), F.array_join(F.slice(seg, F.lit(1), i), "/")))
    return F.when(host(url) != "", F.array_distinct(F.concat(suffixes, prefixes))).otherwise(
        F.array().cast("array<string>"))


def normal_rule(rule: Column) -> Column:
    """A rule as candidates() writes it: host in lower case without final
    dots, path without slashes at its ends, no white space around."""
    r = F.trim(rule)
    h = F.regexp_replace(F.lower(F.regexp_extract(r, "^[^/]*", 0)), r"\.+$", "")
    p = F.regexp_replace(F.regexp_extract(r, "^[^/]*/(.*)$", 1), r"^/+|/+$", "")
    return F.when(p == "", h).otherwise(F.concat(h, F.lit("/"), F.regexp_replace(p, "/+", "/")))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, rule, at, action 'add'/'remove') -> (list, rule, valid_from,
    valid_to) in epoch seconds; valid_to is null for a rule still listed."""
    e = (entries.select("list", normal_rule(F.col("rule")).alias("rule"), F.col("at").cast("bigint").alias("at"),
                        F.lower(F.trim("action")).alias("action")).dropna()
                .where(F.col("action").isin("add", "remove")).groupBy("list", "rule", "at").agg(F.max("action").alias("action")))  # 'remove' > 'add'
    w = Window.partitionBy("list", "rule").orderBy("at")
    return (e.withColumn("valid_to", F.lead("at").over(w)).where("action = 'add'")
             .select("list", "rule", F.col("at").alias("valid_from"), "valid_to"))


def listed(captures: DataFrame, entries: DataFrame, params: UrlFilterParams | None = None,
           id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """(id, blocked, n_rules, lists, rule, valid_from) per capture: how many
    rules were in force, their lists (sorted, distinct), and the longest of
    the rules (ties: the smallest) with the start of its interval."""
    size = (params or UrlFilterParams()).bucket_seconds
    c = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                        F.col(time_col).cast("bigint").alias("t"))
    spots = (c.where("t is not null").select(F.explode(candidates(F.col("url"))).alias("rule"), "t").distinct()
              .withColumn("bucket", F.floor(F.col("t") / size)))
    iv = intervals(entries)
    last = spots.agg(F.max("bucket")).scalar()
    first = spots.agg(F.min("bucket")).scalar()
    lo = F.greatest(F.floor(F.col("valid_from") / size), first)
    hi = F.least(F.coalesce(F.floor((F.col("valid_to") - 1) / size), last), last)
    spread = iv.withColumn("bucket", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array())))
    hits = (spots.join(spread, ["rule", "bucket"])
                 .where("valid_from <= t and (valid_to is null or t < valid_to)")
                 .groupBy("rule", "t").agg(F.collect_set("list").alias("lists"),
                                           F.max("valid_from").alias("valid_from"),
                                           F.count(F.lit(1)).alias("n")))
    # captures with the same URL and time are one row until the end
    u = c.where("t is not null").select("url", "t").distinct()
    per = (u.select("url", "t", F.explode(candidates(F.col("url"))).alias("rule")).join(hits, ["rule", "t"])
            .groupBy("url", "t")
            .agg(F.sum("n").alias("n_rules"), F.array_join(F.array_sort(F.array_distinct(F.flatten(
                F.collect_list("lists")))), ",").alias("lists"),
                F.min(F.struct((-F.length("rule")).alias("o"), "rule", "valid_from")).alias("best")))
    out = c.join(per, ["url", "t"], "left")
    return out.select(F.col("id").alias(id_col), (F.coalesce("n_rules", F.lit(0)) > 0).alias("blocked"),
                      F.coalesce("n_rules", F.lit(0)).cast("bigint").alias("n_rules"), "lists",
                      F.col("best.rule").alias("rule"), F.col("best.valid_from").alias("valid_from"))
