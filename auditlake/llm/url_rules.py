"""URL rules as a range join of sorted keys.

A rule is a host and the beginning of a path. Its key is the host's labels in reverse, a separator
and the path, so everything under one host and path prefix is one interval of keys, and intervals
nest or are apart. A URL has one key for each of its host's suffixes that is not longer than the
longest rule host. Keys and rules are dealt to slices of the key range and sorted in them; a sweep
keeps the stack of rules whose interval is still open, and its top is a key's longest rule.

Slices come from a bounded sample of the keys; a key that fills several slices by itself is
spread over all of them, and a rule goes to every slice that its interval touches. Equal host and
path pairs are judged once. A null URL or one without ``://`` has an empty host and path and no
rule. Of equal rules the blocking one holds. Repeated rows are judged alike and all come out; an
empty table gives an empty result; of other columns none is read.
"""

from __future__ import annotations

import string
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import shuffle_parts, small_batches

SEPARATOR = "\x01"
LAST = "\U0010ffff"
SAMPLE_PER_SLICE = 40
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def url_parts(url: str = "url") -> tuple[F.Column, F.Column]:
    """Host and path of a URL column; both empty where there is no ``://``."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def key_of(labels: F.Column, path: F.Column) -> F.Column:
    return F.concat(F.array_join(F.reverse(labels), "."), F.lit(SEPARATOR), path)


def judge(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule_host, rule_path, verdict) for those distinct (host, path) that some rule fits.

    ``rules``: host, path, verdict.
    """
    spark = places.sparkSession
    small_batches(spark, 10_000)
    labels = F.split("host", r"\.")
    ruled = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" is after "allow"
    deepest = ruled.agg(F.max(F.size(labels))).first()[0] or 0
    longest = F.least(F.size(labels), F.lit(deepest))
    ends = F.transform(F.sequence(F.lit(1), longest), lambda n: key_of(F.slice(labels, F.size(labels) - n + 1, n), F.col("path")))
    keys = places.filter("host <> ''").select("host", "path", F.explode(ends).alias("key"))

    slices = shuffle_parts(spark)
    rows = places.count()
    step = max(1, rows * max(1, deepest) // (SAMPLE_PER_SLICE * slices))
    sample = keys.filter(F.pmod(F.xxhash64("host", "path", "key"), F.lit(step)) == 0).select("key").limit(8 * SAMPLE_PER_SLICE * slices)
    sampled = sorted(r["key"] for r in sample.collect())
    cuts = [sampled[len(sampled) * k // slices] for k in range(1, slices)] if sampled else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, path, key, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low = bisect_left(cuts, key)
                if verdict is None:
                    wide = bisect_right(cuts, key) - low + 1
                    rows.append((low + (zlib.crc32(f"{host}/{path}".encode()) % wide if wide > 1 else 0), host, path, key, None))
                else:
                    rows += [(k, host, path, key, verdict) for k in range(low, bisect_right(cuts, key + LAST) + 1)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.string()) for c in columns[1:])], ["slice", "host", "path", "key", "verdict"])

    both = keys.withColumn("verdict", F.lit(None).cast("string")).union(ruled.select("host", "path", key_of(labels, F.col("path")), "verdict"))
    dealt = both.mapInArrow(deal, "slice int, host string, path string, key string, verdict string").repartition(slices, "slice")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, active = None, []
        for batch in batches:
            out = []
            for at, host, path, key, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != now:
                    now, active = at, []
                while active and not key.startswith(active[-1][0]):
                    active.pop()
                if verdict is not None:
                    active.append((key, host, path, verdict))
                elif active:
                    out.append((host, path, *active[-1][1:]))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["host", "path", "rule_host", "rule_path", "verdict"])

    # At equal keys rules come before URLs; a shorter rule key before a longer one that it holds.
    ordered = dealt.sortWithinPartitions("slice", "key", F.col("verdict").isNull())
    found = ordered.mapInArrow(sweep, "host string, path string, rule_host string, rule_path string, verdict string")
    size = F.struct(F.length("rule_host"), F.length("rule_path"))
    best = found.groupBy("host", "path").agg(F.max_by(F.struct("rule_host", "rule_path", "verdict"), size).alias("best"))
    return best.select("host", "path", "best.*")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null without one) and verdict of every page."""
    host, path = url_parts()
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = judge(parts.select("host", "path").distinct(), rules)
    return parts.join(judged, ["host", "path"], "left").select("page_id", "host", "path", F.concat("rule_host", "rule_path").alias("rule"), F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op2_range_join_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: every page's URL under the five fixed rules."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)


OP2_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN NULL ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path
"""
