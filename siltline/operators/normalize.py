"""Normalisation: a family's parsed values as columns of a nested event, with the cause of every absence and lineage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.functions import columns as C
from siltline.operators.envelopes import envelope_value


@dataclass(frozen=True)
class Mapping:
    """``attribute`` (dotted) from a parsed ``path``, a ``constant`` or an ``envelope`` field, by a transform.

    Transforms: none, int, float, lowercase, epoch_ms, lookup (``table``, ``default``), compose_datetime (paths date, time
    and maybe zone in ``parts``).
    """

    attribute: str
    path: str | None = None
    constant: object = None
    envelope: str | None = None
    transform: str = "none"
    table: tuple[tuple[str, str], ...] = ()
    default: str | None = None
    parts: tuple[str, ...] = ()


#: Category of an event class: its thousands.
def category(class_uid: Column) -> Column:
    return F.floor(class_uid / 1000).cast("int")


def compose_datetime(date: Column, time: Column, zone: Column | None = None) -> Column:
    """Milliseconds of ``yyyy-MM-dd`` and ``HH:mm:ss``, at an offset or in UTC."""
    offset = F.coalesce(C.utc_offset(zone), F.lit("+00:00")) if zone is not None else F.lit("+00:00")
    return F.unix_millis(F.try_to_timestamp(F.concat(date, F.lit(" "), time, offset), F.lit("yyyy-MM-dd HH:mm:ssXXX")))


def _transformed(m: Mapping, text: Column, values: Column) -> Column:
    if m.transform == "lookup":
        return C.lookup(text, dict(m.table), m.default)
    if m.transform == "compose_datetime":
        return compose_datetime(*(F.try_element_at(values, F.lit(p)) for p in m.parts))
    made = {"none": lambda: text, "int": lambda: C.to_int(text), "float": lambda: C.to_float(text), "lowercase": lambda: F.lower(text), "epoch_ms": lambda: C.epoch_auto(C.to_int(text))}
    return made[m.transform]()


def _nested(leaves: dict[str, Column]) -> list[Column]:
    """Columns from dotted names, as structs."""
    tree: dict = {}
    for name, c in leaves.items():
        at = tree
        *parents, last = name.split(".")
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = c
    struct = lambda t: [(F.struct(*struct(v)) if isinstance(v, dict) else v).alias(k) for k, v in t.items()]
    return struct(tree)


def normalize(df: DataFrame, mappings: list[Mapping], class_uid: int, activity: str | None = None, metadata: dict[str, str] | None = None, parsed: str = "parsed", version: int = 1, lineage: tuple[str, ...] = (), values: str | None = None) -> DataFrame:
    """``df`` with ``event`` (a struct), ``absent`` (attribute, cause) and ``unmapped``.

    Causes: structural (no span), declared_null, uncoercible (the parser kept it opaque), transform_failed. An attribute
    whose cause is none of these is there. ``values`` is a map from path to text of lines that the fast path has read, in
    which nothing is opaque or declared null; without it, the spans of ``parsed`` are read.
    """
    # One map for texts: mapped paths are read from it, the rest is unmapped.
    from siltline.operators.parser import texts

    # It is made once for each row; what is read from it are plain columns, so that what nobody asks for is pruned.
    out = df.select("*", F.inline(F.array(F.struct((F.col(values) if values else texts(parsed)).alias("_values"))))) if values != "_values" else df
    states = None if values else F.col(f"{parsed}.spans")
    leaves, absent = {}, []
    for m in mappings:
        if m.constant is not None:
            leaves[m.attribute] = F.lit(m.constant)
            continue
        if m.envelope:
            text = envelope_value(m.envelope).cast("string")
        else:
            text = F.try_element_at("_values", F.lit(m.path or ""))
        value = _transformed(m, text, F.col("_values"))
        leaves[m.attribute] = value
        has = lambda pick, p=m.path: F.lit(False) if states is None else F.exists(states, lambda s: (s["path"] == (p or "")) & pick(s))
        cause = (
            F.when(has(lambda s: F.coalesce(s["declared_null"], F.lit(False))), "declared_null")
            .when(has(lambda s: s["kind"] == "opaque"), "uncoercible")
            .when(text.isNull() & F.lit(m.transform != "compose_datetime"), "structural")
            .otherwise("transform_failed")
        )
        absent.append(F.when(value.isNull(), F.struct(F.lit(m.attribute).alias("attribute"), cause.alias("cause"))))
    leaves |= {"class_uid": F.lit(class_uid), "category_uid": category(F.lit(class_uid))}
    leaves["type_uid"] = F.lit(class_uid) * 100 + (leaves[activity] if activity else F.lit(0)).cast("int")
    for k, v in (metadata or {}).items():
        leaves.setdefault(f"metadata.{k}", F.lit(v))
    mapped = [F.lit(p) for m in mappings for p in ((m.path,) if m.path else m.parts)]
    rest = F.map_filter("_values", lambda k, v: ~k.isin(*mapped)) if mapped else F.col("_values")
    kept = F.struct(F.lit(version).alias("normalization_version"), *lineage) if lineage else F.struct(F.lit(version).alias("normalization_version"))
    causes = F.array_compact(F.array(*absent)) if absent else F.array().cast("array<struct<attribute:string,cause:string>>")
    event = F.struct(*_nested(leaves), kept.alias("lineage"))
    return out.select(*df.columns, event.alias("event"), causes.alias("absent"), rest.alias("unmapped"))
