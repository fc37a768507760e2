"""The hot path as Structured Streaming: evidence is durable before anything is parsed, and a replayed batch adds nothing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.functions import columns as C
from siltline.operators import envelopes, normalize, parser, routing
from siltline.sources import frames

EVIDENCE = ("event_id", "raw", "raw_hash", "framing", "peer", "ingest_ms")


@dataclass
class Pack:
    """Families with their specifications and mappings."""

    families: list[routing.Family]
    specs: dict[str, dict]
    mappings: dict[str, list[normalize.Mapping]]
    class_uid: int = 4001
    metadata: dict[str, str] = field(default_factory=dict)


def evidence(files: DataFrame, method: str = "newline", ingest_ms: int | None = None) -> DataFrame:
    """Framed files as evidence records with ids that a replay gives again: file and place."""
    f = frames.frames(files.select(F.col("path").alias("peer"), F.unix_millis("modificationTime").alias("at"), "content"), method)
    name = F.concat(F.lit("ev_"), F.substring(F.sha2(F.concat_ws("|", "peer", F.col("frame_index").cast("string")), 256), 1, 26))
    return f.select(name.alias("event_id"), "raw", C.evidence_hash("raw").alias("raw_hash"), "framing", "peer", (F.lit(ingest_ms).cast("long") if ingest_ms is not None else F.col("at")).alias("ingest_ms"))


def interpreted(records: DataFrame, pack: Pack, allowed: str | None = None, held: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> tuple[dict[str, DataFrame], DataFrame]:
    """Events by family, and the quarantine: what was truncated, not routed, or didn't parse, with stage and reason.

    ``held`` may write an intermediate result and read it again: routed rows, and each family's parsed ones, have more than one
    reader, and without it every reader would unwrap, route and parse anew.
    """
    whole = F.col("framing.truncation_status") == "none"
    unwrapped = envelopes.unwrap(records.where(whole))
    kind = F.coalesce(F.get("chain.envelopes", F.size("chain.envelopes") - 1)["kind"], F.lit("raw"))
    routed = routing.route(routing.surfaced(unwrapped.withColumn("_l1", kind), envelope="_l1"), pack.families, allowed=allowed)
    routed = held(routed.select("event_id", "raw_hash", "peer", "ingest_ms", "signature", "chain", "payload", "family", "stage", "candidates", "drift", "unowned"), "routed")
    keys = ["event_id", "raw_hash", "signature"]
    refused = [
        records.where(~whole).select("event_id", "raw_hash", F.lit(None).cast("string").alias("signature"), F.lit("framing").alias("stage"), F.col("framing.truncation_status").alias("reason")),
        routed.where("family IS NULL").select(*keys, "stage", F.to_json(F.struct("candidates", "drift", "unowned")).alias("reason")),
    ]
    events = {}
    for family in pack.families:
        own = routed.where(F.col("family") == family.id).select("event_id", "raw_hash", "peer", "ingest_ms", "signature", "chain", "payload")
        parsed = held(parser.parse(own, pack.specs[family.id], ingest_ms="ingest_ms"), f"parsed-{family.id}")
        refused.append(parsed.where("parsed.status = 'failed'").select(*keys, F.lit("parse").alias("stage"), F.col("parsed.failure").alias("reason")))
        good = parsed.where("parsed.status = 'ok'")
        made = normalize.normalize(good, pack.mappings[family.id], pack.class_uid, metadata=pack.metadata, lineage=("event_id", "raw_hash"))
        events[family.id] = made.select("event_id", F.lit(family.id).alias("family"), F.to_json("event").alias("event"), "absent", F.to_json("unmapped").alias("unmapped"), F.col("event.time").alias("time") if any(m.attribute == "time" for m in pack.mappings[family.id]) else F.col("ingest_ms").alias("time"))
    out = refused[0]
    for r in refused[1:]:
        out = out.unionByName(r)
    return events, out


def batch_writer(path: str, pack: Callable[[], Pack], method: str = "newline") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``. The pack is read anew for each batch, which is how a reload takes effect between frames."""

    def write(files: DataFrame, batch: int) -> None:
        spark = files.sparkSession
        place = f"{path}/evidence/batch_id={batch}"
        evidence(files, method).write.mode("overwrite").parquet(place)
        durable = spark.read.parquet(place)  # what is parsed is what was made durable
        work = f"{path}/work/batch_id={batch}"

        def held(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{work}/{name}")
            return spark.read.schema(df.schema).parquet(f"{work}/{name}")

        events, refused = interpreted(durable, pack(), held=held)
        made = None
        for df in events.values():
            made = df if made is None else made.unionByName(df)
        if made is not None:
            made.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/events/batch_id={batch}")
        refused.write.mode("overwrite").parquet(f"{path}/quarantine/batch_id={batch}")
        place = spark._jvm.org.apache.hadoop.fs.Path(work)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    return write


def run(files: DataFrame, path: str, pack: Callable[[], Pack], method: str = "newline", trigger: dict | None = None):
    """Starts the query; its checkpoint is beside what it writes."""
    return files.writeStream.foreachBatch(batch_writer(path, pack, method)).option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
