"""Onboarding: from samples to a candidate specification, and whether it may be promoted.

Statistics are DataFrame jobs over all samples; what they decide is small and stays on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.functions.columns import token_class
from siltline.operators import parser, routing


def slots(lines: DataFrame, text: str = "raw") -> DataFrame:
    """By slot of whitespace tokens: rows, widened class, distinct values, constant, up to eight sorted samples; of lines of the modal arity."""
    toks = lines.select(routing.tokens(F.col(text).cast("string")).alias("t"))
    arity = toks.groupBy(F.size("t").alias("arity")).count().orderBy(F.desc("count"), "arity").limit(1)
    own = toks.join(F.broadcast(arity), F.size("t") == F.col("arity")).select("arity", F.posexplode("t").alias("slot", "v"))
    values = own.groupBy("arity", "slot", "v").agg(F.count("*").alias("c")).withColumn("class", token_class("v"))
    from pyspark.sql import Window

    values = values.withColumn("p", F.row_number().over(Window.partitionBy("slot").orderBy("v")))
    classes = F.array_sort(F.collect_set("class"))
    widened = F.when(F.size("classes") == 1, F.get("classes", 0)).when(F.array_join("classes", ",") == "float,integer", "float").otherwise("text")
    out = values.groupBy("arity", "slot").agg(F.sum("c").alias("n"), classes.alias("classes"), F.count("*").alias("n_distinct"), F.array_sort(F.collect_list(F.when(F.col("p") <= 8, F.col("v")))).alias("samples"))
    return out.select("arity", "slot", "n", widened.alias("class"), "n_distinct", (F.col("n_distinct") == 1).alias("constant"), "samples")


def induce(lines: DataFrame, text: str = "raw", id: str = "induced") -> dict:
    """A positional specification of the modal structure: constants stay slots, so that what varies later is seen."""
    found = sorted(slots(lines, text).collect(), key=lambda r: r.slot)  # a row for each slot
    return {"id": id, "parse": {"op": "positional", "slots": [{"field": f"slot_{r.slot}", "class": {"url": "text", "word": "text"}.get(r["class"], r["class"])} for r in found]}}


def draft(lines: DataFrame, text: str = "raw", id: str = "draft", share: float = 0.0) -> dict:
    """A specification of the samples' most common surface: kv and json by the keys that are there, csv by its cells."""
    faced = routing.surfaced(lines.select(F.col(text).cast("string").alias("payload")))
    top = faced.groupBy("l2").count().orderBy(F.desc("count"), "l2").first()
    if top.l2 == "kv":
        keys = faced.where("l2 = 'kv'").select(F.explode("pairs").alias("p")).groupBy("p.key").count().orderBy("key").collect()
        return {"id": id, "parse": {"op": "kv", "keys": {r.key: {} for r in keys if r["count"] >= share * top["count"]}}}
    if top.l2 == "csv":
        n = faced.where("l2 = 'csv'").groupBy("arity").count().orderBy(F.desc("count"), "arity").first().arity
        return {"id": id, "parse": {"op": "csv", "fields": [{"field": f"cell_{k}"} for k in range(n)]}}
    if top.l2 == "json":
        # Unknown keys are opaque spans with their path: one parse lists all leaves.
        seen = parser.parse(faced.where("l2 = 'json'").select("payload"), {"id": id, "parse": {"op": "json", "keys": {}}})
        paths = seen.select(F.explode("parsed.spans").alias("s")).where("s.kind = 'opaque'").groupBy("s.path").count().orderBy("path").collect()
        return {"id": id, "parse": {"op": "json", "keys": {r.path.removeprefix("unknown."): {} for r in paths}}}
    return induce(lines, text, id)


@dataclass(frozen=True)
class Verdict:
    parsed: float
    byte_coverage: float
    semantic_coverage: float
    held_out: float
    accepted: bool


def acceptance(lines: DataFrame, held_out: DataFrame, spec: dict, text: str = "raw", least_parsed: float = 1.0, least_semantic: float = 0.0) -> Verdict:
    """Coverage of the samples' bytes by understood spans, and whether held-out samples parse as well."""

    def measured(df: DataFrame):
        p = parser.parse(df.select(F.col(text).cast("binary").alias("payload")), spec)
        size = lambda kinds: F.aggregate(F.filter("parsed.spans", lambda s: s["kind"].isin(*kinds) & (s["buffer"] == parser.RAW)), F.lit(0), lambda n, s: n + s["stop"] - s["start"])
        return p.agg(F.avg((F.col("parsed.status") == "ok").cast("double")).alias("ok"), (F.sum(size(["semantic", "literal"])) / F.sum(F.octet_length("payload"))).alias("bytes"), (F.sum(size(["semantic"])) / F.sum(size(["semantic", "opaque"]))).alias("semantic")).first()

    a, b = measured(lines), measured(held_out)
    ok, held = a.ok or 0.0, b.ok or 0.0
    return Verdict(ok, a.bytes or 0.0, a.semantic or 0.0, held, ok >= least_parsed and held >= least_parsed and (a.semantic or 0.0) >= least_semantic)


def admitted_anchors(values: DataFrame, family: str = "family", value: str = "value") -> DataFrame:
    """Anchors whose values belong to one family each: (anchor, admitted)."""
    owned = values.groupBy("anchor", value).agg(F.count_distinct(family).alias("n"))
    return owned.groupBy("anchor").agg(F.bool_and(F.col("n") == 1).alias("admitted"))


def candidates(fields: DataFrame, attributes: DataFrame) -> DataFrame:
    """Attributes whose type accepts a field's class, and whose domain holds all its samples: (field, attribute)."""
    fits = F.array_contains("accepts", F.col("class"))
    inside = F.col("domain").isNull() | F.forall("samples", lambda v: F.array_contains("domain", v))
    # The attribute table is the event schema's, whose size is that of the schema and not of the data.
    return fields.join(F.broadcast(attributes), fits & inside).select("field", "attribute")


def propagated(fields: DataFrame, store: DataFrame) -> DataFrame:
    """What earlier decisions say about fields of the same key: (field, attribute, origin)."""
    return fields.join(store, "slot_key", "left").select("field", "attribute", F.when(F.col("attribute").isNotNull(), "propagated").otherwise("open").alias("origin"))


def rivals(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, member, leaf) of the members (member, leaf) whose name a class's wildcard (class, pattern, leaf) matches, at the same leaf.

    Wildcards: ``*`` any characters, ``?`` one.
    """
    # Everything but the wildcards stands for itself.
    quoted = F.regexp_replace("pattern", r"([^A-Za-z0-9*?])", r"\\$1")
    matches = F.rlike(F.col("member"), F.concat(F.lit("^(?s)"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("\\z")))
    return members.join(classes, "leaf").where(matches).select("class", "member", "leaf")
