"""Routing: which one family's parser an event goes to, from its surface alone. Nothing is guessed or tried.

Levels: the envelope (L1), the surface class (L2), anchors (L3: a value that only one pack's sources have), and arity or
token classes (L4). Exactly one surviving family routes an event; none is ``routing``, or ``routing_drift`` if an anchor's
value was outside its domain; two to ``most`` are ``routing_ambiguous``, more ``routing_cap``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.functions.columns import token_class

KV_TOKEN = r"^[A-Za-z_][A-Za-z0-9_.\-]*="


@dataclass(frozen=True)
class Anchor:
    """Where a value is: ``key`` (kv), ``slot`` (tokens or csv), ``pattern`` (first group) or ``envelope`` (header field); and its domain."""

    id: str
    kind: str
    at: str
    values: tuple[str, ...]
    retired: bool = False


@dataclass(frozen=True)
class Family:
    id: str
    pack: str
    envelope: str = "raw"
    surface: str = "tokens"
    anchors: tuple[Anchor, ...] = ()
    arity: tuple[int, int] | None = None
    classes: tuple[str, ...] = field(default=())


def tokens(payload: Column) -> Column:
    return F.filter(F.split(payload, r"\s+"), lambda t: t != "")


def cells(payload: Column) -> Column:
    """Comma-separated outside double quotes."""
    return F.regexp_extract_all(F.concat(payload, F.lit(",")), F.lit(r'((?:"(?:[^"]|"")*"|[^",])*),'), 1)


def surface(payload: Column) -> Column:
    """json, xml, kv, csv or tokens."""
    trimmed = F.regexp_replace(payload, r"^[ \t]+", "")
    pairs = F.size(F.filter(F.slice(tokens(payload), 1, 6), lambda t: t.rlike(KV_TOKEN)))
    return (
        F.when(trimmed.rlike(r"^[{\[]"), "json")
        .when(trimmed.rlike("^<[?!A-Za-z_]"), "xml")
        .when(pairs >= 3, "kv")
        .when(F.size(cells(payload)) >= 9, "csv")
        .otherwise("tokens")
    )


def pairs(payload: Column) -> Column:
    """Keys and values in order; values may be quoted with backslash escapes."""
    found = F.regexp_extract_all(payload, F.lit(r'([^=\s]+=(?:"(?:[^"\\]|\\.)*"|[^ \t]*))'), 1)
    value = lambda t: F.regexp_replace(F.regexp_replace(F.substr(t, F.instr(t, "=") + 1), r'^"((?s).*)"$', "$1"), r"\\(.)", "$1")
    return F.transform(found, lambda t: F.struct(F.substring_index(t, "=", 1).alias("key"), value(t).alias("value")))


def surfaced(df: DataFrame, payload: str = "payload", envelope: str | None = None) -> DataFrame:
    """``df`` with surface facts, each computed once: l1, l2, toks, cells, pairs, arity, classes."""
    p = F.col(payload).cast("string")
    out = df.withColumn("l1", F.col(envelope) if envelope else F.lit("raw")).withColumn("l2", surface(p))
    out = out.withColumn("toks", F.when(F.col("l2") == "tokens", tokens(p))).withColumn("cells", F.when(F.col("l2") == "csv", cells(p))).withColumn("pairs", F.when(F.col("l2") == "kv", pairs(p)))
    return out.withColumn("arity", F.coalesce(F.size("toks"), F.size("cells"), F.size("pairs"))).withColumn("classes", F.transform("toks", token_class))


def located(anchor: Anchor, payload: str) -> Column:
    """The anchor's value; null if it isn't there."""
    if anchor.kind == "key":
        return F.get(F.filter("pairs", lambda x: x["key"] == anchor.at), 0)["value"]
    if anchor.kind == "slot":
        return F.get(F.coalesce("toks", "cells"), int(anchor.at))
    if anchor.kind == "pattern":
        return F.nullif(F.regexp_extract(F.col(payload).cast("string"), anchor.at, 1), F.lit(""))
    return F.col(anchor.at)


def l1_fits(family: Family) -> Column:
    return {"raw": ~F.col("l1").isin("cef", "leef"), "any": F.lit(True)}.get(family.envelope, F.col("l1") == family.envelope)


def l4_fits(family: Family) -> Column:
    out = F.lit(True)
    if family.arity:
        out = out & F.col("arity").between(*family.arity)
    if family.classes:
        out = out & F.coalesce(F.col("classes") == F.array(*map(F.lit, family.classes)), F.lit(False))
    return out


def route(df: DataFrame, families: list[Family], payload: str = "payload", allowed: str | None = None, most: int = 4) -> DataFrame:
    """``df`` (with ``surfaced``'s columns) with family, stage (routed, routing, routing_drift, routing_ambiguous, routing_cap), candidates, drift, unowned and signature.

    Families are part of the plan: their predicates are evaluated in one pass, without a join. ``allowed`` is a column with
    the packs that a source is bound to; null allows all.
    """
    survivors, drift, unowned, hits = [], [], [], []
    for f in families:
        level2 = l1_fits(f) & (F.col("l2") == f.surface)
        if allowed:
            level2 = level2 & (F.col(allowed).isNull() | F.array_contains(allowed, f.pack))
        level3 = F.lit(True)
        for a in f.anchors:
            if a.retired:
                continue
            value = located(a, payload)
            owned = F.coalesce(value.isin(*a.values), F.lit(False))
            hits.append(F.when(level2 & owned, F.lit(a.id)))
            drift.append(F.when(level2 & value.isNotNull() & ~owned, F.struct(F.lit(a.id).alias("anchor"), value.alias("value"))))
            unowned.append(F.when(level2 & value.isNull(), F.lit(a.id)))
            level3 = level3 & owned
        survivors.append(F.when(level2 & level3 & l4_fits(f), F.lit(f.id)))
    some = lambda xs, kind: F.array_sort(F.array_distinct(F.array_compact(F.array(*xs)))) if xs else F.array().cast(kind)
    out = df.withColumn("candidates", some(survivors, "array<string>")).withColumn("drift", some(drift, "array<struct<anchor:string,value:string>>")).withColumn("unowned", some(unowned, "array<string>")).withColumn("_hits", some(hits, "array<string>"))
    n = F.size("candidates")
    stage = F.when(n == 1, "routed").when(n > most, "routing_cap").when(n > 1, "routing_ambiguous").when(F.size("drift") > 0, "routing_drift").otherwise("routing")
    signature = F.concat_ws("|", "l1", "l2", F.array_join("_hits", ","), F.coalesce(F.col("arity").cast("string"), F.lit("")), F.when(F.size("classes") > 0, F.array_join("classes", ",")))
    return out.withColumn("stage", stage).withColumn("family", F.when(n == 1, F.get("candidates", 0))).withColumn("signature", signature).drop("_hits")
