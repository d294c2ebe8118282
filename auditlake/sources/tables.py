"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import schemas
from auditlake.dims import PROFILES
from auditlake.functions.html import normalize_newlines
from auditlake.session import stage


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages, line ends normalised once on the way in."""
    pages = spark.read.schema(schemas.PAGES).parquet(path)
    return pages.withColumns({c: normalize_newlines(F.col(c)) for c in ("raw_html", "rendered_html")})


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RESPONSES).parquet(path)


def read_run_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per run, each on one line; unreadable ones give no run id and are dropped."""
    docs = spark.read.schema(schemas.RUN_DOCUMENT).json(path)
    return docs.where(F.col("id").isNotNull())


def runs_of(docs: DataFrame) -> DataFrame:
    r = F.col("result")
    return docs.select(
        F.col("id").alias("run_id"),
        "status",
        r["config"]["rootUrl"].alias("root_url"),
        r["startedAt"].alias("started_at"),
        r["finishedAt"].alias("finished_at"),
        r["siteStats"]["pagesScanned"].alias("pages_scanned"),
        F.coalesce(r["siteStats"]["source"], F.lit("bfs")).alias("source"),
        F.coalesce(r["siteStats"]["capped"], F.lit(False)).alias("capped"),
        r["siteStats"]["avgJsGatedFraction"].alias("avg_js_gated_fraction"),
        r["siteStats"]["fixBacklog"].alias("fix_backlog"),
        F.coalesce("errorMessage", r["errorMessage"]).alias("error_message"),
    )


def run_pages_of(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("id").alias("run_id"), F.posexplode("result.pages").alias("page_index", "p"))
    return rows.select(
        "run_id",
        F.col("page_index").cast("bigint").alias("page_index"),
        "p.url",
        F.col("p.diff.largestProfile").alias("largest_profile"),
        F.coalesce("p.diff.jsGatedFraction", F.lit(0.0)).alias("js_gated_fraction"),
    )


def run_profiles_of(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("id").alias("run_id"), F.posexplode("result.pages").alias("page_index", "p"))
    each = rows.select("run_id", "page_index", "p.url", F.explode("p.profiles").alias("profile", "r"))
    return each.select(
        "run_id",
        F.col("page_index").cast("bigint").alias("page_index"),
        "url",
        "profile",
        profile_ord(F.col("profile")).alias("profile_ord"),
        F.coalesce("r.ok", F.lit(False)).alias("ok"),
        "r.reason",
        F.coalesce("r.bytes", F.lit(0)).alias("bytes"),
        F.coalesce("r.chars", F.lit(0)).alias("chars"),
        F.coalesce("r.tokensClaude", F.lit(0)).alias("tokens_est"),
        F.coalesce("r.markdown", F.lit("")).alias("markdown"),
        F.col("r.rawArtifact").alias("artifact"),
        "r.screenshot",
    )


def run_findings_of(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("id").alias("run_id"), F.posexplode("result.fixes").alias("seq", "f"))
    return rows.select(
        "run_id",
        F.col("seq").cast("bigint").alias("seq"),
        F.col("f.id").alias("finding_id"),
        "f.title",
        "f.severity",
        "f.source",
        "f.evidence",
        F.col("f.fixHint").alias("fix_hint"),
        F.col("f.pageUrl").alias("page_url"),
        F.coalesce("f.occurrences", F.lit(1)).alias("occurrences"),
    )


def profile_ord(profile: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, p in enumerate(PROFILES):
        out = F.when(profile == p, F.lit(i)).otherwise(out)
    return out


def finished(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of runs that are no longer running."""
    return rows.join(runs.where(F.col("status") != "running").select("run_id"), "run_id", "left_semi")


def run_bucket(run_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(buckets)).cast("int")


def _has_files(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_runs(runs: DataFrame, tables: dict[str, DataFrame], path: str, buckets: int = 16) -> None:
    """Add finished runs to stored tables; runs still going on are left out.

    A run that is stored already is replaced, all others stay as they are: only folders that
    receive a run are written anew, with the other runs they hold.

    One folder per run would leave a lake of tiny files, so runs share a fixed number of folders
    and are sorted within a file, which lets a reader of one run skip the rest. Rebalancing gathers
    a folder's rows into few files and splits the rows of a large run over several.
    """
    done = stage(runs.where(F.col("status") != "running"), "finished-runs")
    ids = done.select("run_id").distinct()
    touched = [r["b"] for r in ids.select(run_bucket(F.col("run_id"), buckets).alias("b")).distinct().collect()]
    for name, df in {"runs": done, **{n: finished(t, runs) for n, t in tables.items()}}.items():
        placed = df.withColumn("run_bucket", run_bucket(F.col("run_id"), buckets))
        if _has_files(placed.sparkSession, f"{path}/{name}"):
            # At most ``buckets`` folder numbers; what they hold of other runs is read before it is replaced.
            held = placed.sparkSession.read.parquet(f"{path}/{name}").where(F.col("run_bucket").isin(touched)).join(ids, "run_id", "left_anti")
            placed = stage(placed.unionByName(held, allowMissingColumns=True), "stored-runs")
        ordered = placed.hint("rebalance", F.col("run_bucket")).sortWithinPartitions("run_bucket", "run_id")
        ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_bucket").parquet(f"{path}/{name}")


def read_run_table(spark: SparkSession, path: str, name: str, run_id: str | None = None, buckets: int = 16) -> DataFrame:
    """A stored table, or the rows of one run in it: its folder first, then its row groups."""
    table = spark.read.parquet(f"{path}/{name}")
    if run_id is not None:
        table = table.where((F.col("run_bucket") == run_bucket(F.lit(run_id), buckets)) & (F.col("run_id") == run_id))
    return table.drop("run_bucket")


def slim(profiles: DataFrame) -> DataFrame:
    """Profiles without their raw artifacts."""
    return profiles.drop("artifact")


def prune(profiles: DataFrame) -> DataFrame:
    """Profiles for a showcase: no artifacts, and texts and screenshots of the first page only."""
    first = F.col("page_index") == 0
    kept = slim(profiles)
    return kept.withColumns({c: F.when(first, F.col(c)) for c in ("markdown", "screenshot") if c in kept.columns})
