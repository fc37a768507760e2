"""The event lake: partitioned Parquet, immutable versions with a manifest, evidence by batch, renormalisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.functions import columns as C
from siltline.operators import provenance

PARTITIONS = ("region", "account_id", "event_day")


def with_partitions(events: DataFrame, time: str = "time", region: str = "local", account: str = "0") -> DataFrame:
    return events.withColumn("region", F.lit(region)).withColumn("account_id", F.lit(account)).withColumn("event_day", C.event_day(time))


def write_events(events: DataFrame, path: str, batch: int | None = None, most_rows: int = 1_000_000) -> None:
    """Appends to the lake; with a batch, its own partition is replaced, so that a replay adds nothing."""
    out, parts = events, list(PARTITIONS)
    if batch is not None:
        out, parts = out.withColumn("batch_id", F.lit(batch)), ["batch_id", *parts]
    writer = out.repartition("event_day").sortWithinPartitions("event_day").write.partitionBy(*parts).option("compression", "zstd").option("maxRecordsPerFile", most_rows)
    if batch is None:
        writer.mode("append").parquet(path)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def content_hash(events: DataFrame, columns: list[str]) -> DataFrame:
    """(n, content): a SHA-256 over all rows that doesn't depend on their order.

    Rows' hashes, in order, are a tree in each of 4096 ranges of hashes, and the ranges' roots, in order, are hashed.
    """
    rows = events.select(F.sha2(F.to_json(F.struct(*columns)), 256).alias("leaf")).withColumn("range", F.substring("leaf", 1, 3))
    ranges = provenance.rooted(rows, "range", "leaf")
    # A row for each of 4096 ranges at most.
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "root"))), lambda x: F.concat(x["range"], x["root"])), "|")
    return ranges.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(whole, 256).alias("content"))


def version_path(path: str, version: int) -> str:
    return f"{path}/normalization_version={version}"


def write_version(events: DataFrame, path: str, version: int, derived_from: int | None = None, changes: str = "") -> None:
    """Writes a version once: a version that is there is never written again."""
    events.write.mode("errorifexists").option("compression", "zstd").parquet(version_path(path, version))
    spark, columns = events.sparkSession, sorted(events.columns)
    stored = spark.read.schema(events.schema).parquet(version_path(path, version))
    line = content_hash(stored, columns).select(F.lit(version).alias("version"), F.lit(derived_from).cast("int").alias("derived_from"), "n", "content", F.lit(changes).alias("changes"))
    line.coalesce(1).write.mode("errorifexists").parquet(f"{path}_manifest/version={version}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}_manifest").select(F.col("version").cast("int").alias("version"), "derived_from", "n", "content", "changes")


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """All versions with their number."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def verify(spark: SparkSession, path: str, schema) -> DataFrame:
    """(version, finding) of what is not as its manifest says, or not derived from a version that is there."""
    lines = manifest(spark, path).collect()  # a row for each version
    known, found = {r.version for r in lines}, []
    for r in lines:
        now = content_hash(spark.read.schema(schema).parquet(version_path(path, r.version)), sorted(schema.names)).first()
        if now.n != r.n:
            found.append((r.version, "count"))
        elif now.content != r.content:
            found.append((r.version, "content"))
        if r.derived_from is not None and r.derived_from not in known:
            found.append((r.version, "chain"))
    return spark.createDataFrame(found, "version int, finding string")


def latest(versions: DataFrame, key: str = "event_id", version: str = "normalization_version") -> DataFrame:
    """Each event's last version, by aggregation."""
    rest = [c for c in versions.columns if c not in (key, version)]
    return versions.groupBy(key).agg(F.max(F.struct(version, F.struct(*rest).alias("_r"))).alias("l")).select(key, F.col(f"l.{version}").alias(version), "l._r.*")


def renormalize(spark: SparkSession, path: str, schema, evidence: DataFrame, derive: Callable[[DataFrame], DataFrame], key: str = "event_id", changes: str = "") -> dict[str, int]:
    """Derives every event again from its evidence and writes what differs as a new version.

    Refused if a version isn't as its manifest says, if evidence is missing, or if raw bytes don't have their hash.
    ``derive`` gives ``schema``'s columns for evidence rows (or no row for one that no longer applies). Gives the numbers of
    corrected, unchanged and not applicable events; nothing is written if none is corrected.
    """
    if not verify(spark, path, schema).isEmpty():
        raise ValueError("the lake isn't as its manifests say")
    now = latest(read_versions(spark, path), key)
    raw = now.select(key).join(evidence, key, "left")
    bad = raw.where(F.col("raw").isNull() | (C.evidence_hash("raw") != F.col("raw_hash")))
    if not bad.isEmpty():
        raise ValueError("evidence is missing or altered")
    made = derive(raw)
    both = now.select(key, F.struct(*(c for c in schema.names if c != key)).alias("old")).join(made.select(key, F.struct(*(c for c in schema.names if c != key)).alias("new")), key, "left")
    outcome = F.when(F.col("new").isNull(), "not_applicable").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("corrected")
    judged = both.withColumn("outcome", outcome)
    counts = {r.outcome: r["count"] for r in judged.groupBy("outcome").count().collect()}
    if counts.get("corrected"):
        last = manifest(spark, path).agg(F.max("version")).first()[0]
        write_version(judged.where("outcome = 'corrected'").select(key, "new.*").select(*schema.names), path, last + 1, last, changes)
    return {k: counts.get(k, 0) for k in ("corrected", "unchanged", "not_applicable")}
