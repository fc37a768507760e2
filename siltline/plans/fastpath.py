"""Specifications that Spark's own expressions can state: values as Columns, and the parser only for lines that don't fit.

``fields`` gives a Column of text for each field, and what a line must look like for that, or ``None`` where a specification
needs the parser (escapes, decoders, repeats, opaque values, classes that Columns don't check in full). A line that fits is one
whose every byte is a value or the syntax around it, each value of its class and coercible: on those the parser would say the
same. All other lines go to the parser, in the same plan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.functions import columns as C
from siltline.operators import parser

WHITE = "[ \\t]+"
KINDS = {"int": "v_long", "float": "v_double", "bool": "v_bool", "enum": "v_string", "mac": "v_string", "ipv4": "v_string", "string": "v_string", "timestamp": "v_long"}


@dataclass
class Fields:
    """``parts``: Columns on the payload, made first; ``texts``: path to text, on parts; ``fits``: on parts and texts."""

    parts: dict[str, Column]
    texts: dict[str, Column]
    cells: dict[str, dict]
    fits: list[Column]


def _plain(cells) -> bool:
    return not any(c.get("decode") or c.get("opaque") or c.get("class") in ("ipv6", "ip") or coercion(F.lit(""), c) is None for c in cells)


def coercion(text: Column, cell: dict) -> Column | None:
    """The coerced value of a text; the text itself without a coercion; ``None`` if Columns don't have it."""
    to = cell.get("coerce")
    if not to:
        return text
    if to["to"] == "timestamp":
        kind = (to.get("format") or {}).get("kind", "")
        if kind == "epoch_auto":
            return C.epoch_auto(C.to_int(text))
        return C.epoch(C.to_int(text), kind[6:]) if kind in ("epoch_s", "epoch_ms", "epoch_us", "epoch_ns") else None
    if to["to"] == "enum":
        return C.to_enum(text, list(to["values"]))
    known = {"string": lambda: text, "int": lambda: C.to_int(text), "float": lambda: C.to_float(text), "bool": lambda: C.to_bool(text), "mac": lambda: C.to_mac(text), "ipv4": lambda: C.to_ipv4(text)}
    return known[to["to"]]() if to["to"] in known else None


def java(pattern: str) -> str:
    return re.sub(r"\(\?P<[^>]+>", "(", pattern)


def _regex(step: dict, text: Column) -> tuple[dict[str, Column], Column] | None:
    if not _plain(step["captures"].values()):
        return None
    whole = f"^(?:{java(step['pattern'])})\\z"
    return {g: F.regexp_extract(text, whole, n) for g, n in re.compile(step["pattern"]).groupindex.items()}, text.rlike(whole)


def fields(spec: dict, payload: str) -> Fields | None:
    step = spec["parse"]
    if isinstance(step, list):
        if len(step) != 1:
            return None
        step = step[0]
    text = F.col(payload).cast("string")
    if step["op"] == "kv":
        cells = step["keys"]
        if not _plain(cells.values()) or set(step) - {"op", "keys"}:
            return None
        one = rf"(?:{'|'.join(map(re.escape, cells))})=[^ \t\"\\]+"
        parts = {"_n": F.size(F.split(text, WHITE)), "_line": text.rlike(rf"^{one}(?:[ \t]+{one})*\z")}
        texts = {k: F.regexp_extract(text, rf"(?:^|[ \t]){re.escape(k)}=([^ \t]*)", 1) for k in cells}
        # As many keys as pairs: none is there twice.
        there = sum((F.col(f"_t{n}").isNotNull().cast("int") for n in range(len(cells))), F.lit(0))
        return Fields(parts, texts, cells, [F.col("_line"), F.col("_n") == there])
    if step["op"] == "positional":
        if set(step) - {"op", "slots", "tail"}:
            return None
        n, tail, cells, texts, fits = len(step["slots"]), step.get("tail"), {}, {}, []
        for k, slot in enumerate(step["slots"]):
            part = F.get("_parts", k)
            if "field" in slot:
                cells[slot["field"]], texts[slot["field"]] = slot, part
                continue
            sub = slot.get("parse")
            if not isinstance(sub, list) or len(sub) != 1 or sub[0]["op"] != "regex" or not (found := _regex(sub[0], part)):
                return None
            cells |= sub[0]["captures"]
            texts |= found[0]
            fits.append(found[1])
        if tail:
            cells[tail["field"]], texts[tail["field"]] = tail, F.get("_parts", n)
        if not _plain(cells.values()):
            return None
        # The tail's text is the rest of the line as it is.
        return Fields({"_parts": F.split(text, WHITE, n + 1 if tail else -1)}, texts, cells, [F.size("_parts") == n + bool(tail), F.get("_parts", 0) != "", *fits])
    if step["op"] == "csv":
        if not _plain(step["fields"]) or set(step) - {"op", "fields"}:
            return None
        cells = {c["field"]: c for c in step["fields"]}
        parts = {"_cells": F.regexp_extract_all(F.concat(text, F.lit(",")), F.lit(r'((?:"(?:[^"]|"")*"|[^",]*)),'), 1), "_size": F.length(text)}
        texts = {}
        for k, name in enumerate(cells):
            cell = F.get("_cells", k)
            texts[name] = F.when(cell.startswith('"'), F.replace(F.substr(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))).otherwise(cell)
        whole = F.aggregate("_cells", F.lit(-1), lambda s, x: s + F.length(x) + 1)
        return Fields(parts, texts, cells, [F.size("_cells") == len(cells), whole == F.col("_size")])
    if step["op"] == "regex":
        found = _regex(step, F.col("_text"))
        return found and Fields({"_text": text}, found[0], step["captures"], [found[1]])
    return None


def bound(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """``df`` with more columns, computed once for each row: neither filters nor other columns on them repeat what makes them,
    as they would if these were plain projections, which the optimiser merges."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in made.items())))))


def split(df: DataFrame, spec: dict, payload: str = "payload") -> tuple[DataFrame, DataFrame, dict[str, Column]] | None:
    """The lines that fit, with columns of text; the others, as they came; and by path the coerced value on the former."""
    found = fields(spec, payload)
    if found is None:
        return None
    paths = list(found.cells)
    out = bound(bound(df, found.parts), {f"_t{n}": F.nullif(found.texts[p], F.lit("")) for n, p in enumerate(paths)})
    out = bound(out, {f"_v{n}": coercion(F.col(f"_t{n}"), found.cells[p]) for n, p in enumerate(paths)})
    all_fit = F.octet_length(F.col(payload).cast("binary")) <= spec.get("max_event_bytes", 1 << 16)
    for f in found.fits:
        all_fit = all_fit & f
    for n, p in enumerate(paths):
        text, cell = F.col(f"_t{n}"), found.cells[p]
        good = F.col(f"_v{n}").isNotNull()
        # An address that was coerced is one; numbers are coerced from more than their classes have.
        if cell.get("class", "text") != "text" and (cell["class"], (cell.get("coerce") or {}).get("to")) != ("ipv4", "ipv4"):
            good = good & C.is_class(cell["class"], text)
        if cell.get("null"):
            good = good & ~text.isin(*cell["null"])
        all_fit = all_fit & (text.isNull() | good)
    out = bound(out, {"_fits": F.coalesce(all_fit, F.lit(False))})
    return out.where("_fits"), out.where("NOT _fits").select(*df.columns), {p: F.col(f"_v{n}") for n, p in enumerate(paths)}


def text_of(path: str, parsed: str = "parsed") -> Column:
    return F.get(F.filter(F.col(f"{parsed}.spans"), lambda x: x["path"] == path), 0)["text"]


def value_of(path: str, kind: str, parsed: str = "parsed") -> Column:
    return F.get(F.filter(F.col(f"{parsed}.spans"), lambda x: x["path"] == path), 0)["coerced"][kind]


def values(df: DataFrame, spec: dict, wanted: dict[str, str], keep: tuple[str, ...] = (), payload: str = "payload") -> DataFrame:
    """The columns ``keep`` and, by name, the value of each wanted path: coerced where the specification coerces it, else its text."""
    made = split(df, spec, payload)

    def parsed(lines: DataFrame) -> DataFrame:
        kinds = cells_of(spec)
        p = parser.parse(lines, spec, payload=payload)
        get = lambda path: value_of(path, KINDS.get(kinds[path]["coerce"]["to"], "v_string")) if kinds.get(path, {}).get("coerce") else text_of(path)
        return p.select(*keep, *(get(path).alias(name) for name, path in wanted.items()))

    if made is None:
        return parsed(df)
    fast, slow, found = made
    return fast.select(*keep, *(found[path].alias(name) for name, path in wanted.items())).unionByName(parsed(slow))


def cells_of(spec: object) -> dict[str, dict]:
    """All cells of a specification by their field's name."""
    if isinstance(spec, list):
        return {k: v for s in spec for k, v in cells_of(s).items()}
    if not isinstance(spec, dict):
        return {}
    out = {spec["field"]: spec} if "field" in spec else {}
    for key, inner in spec.items():
        if key in ("keys", "captures", "paths") and isinstance(inner, dict):
            out |= inner
        else:
            out |= cells_of(inner)
    return out


def mapped(df: DataFrame, spec: dict, payload: str = "payload", into: str = "_values") -> tuple[DataFrame, DataFrame] | None:
    """The lines that fit, with a map from path to text; and the others."""
    made = split(df, spec, payload)
    if made is None:
        return None
    fast, slow, found = made
    pairs = F.create_map(*(x for n, p in enumerate(found) for x in (F.lit(p), F.col(f"_t{n}"))))
    return bound(fast, {into: F.map_filter(pairs, lambda k, v: v.isNotNull())}).select(*df.columns, into), slow


def columns(spec: dict, payload: str) -> dict[str, Column] | None:
    """Field to text, for lines that are known to fit; nulls where it is absent, empty or declared null."""
    found = fields(spec, payload)
    if found is None or spec["parse"] and (spec["parse"][0] if isinstance(spec["parse"], list) else spec["parse"])["op"] not in ("kv", "positional", "regex"):
        return None
    step = spec["parse"][0] if isinstance(spec["parse"], list) else spec["parse"]
    text = F.col(payload).cast("string")
    if step["op"] == "positional":
        if "tail" in step or not all("field" in c for c in step["slots"]):
            return None
        parts = F.split(text, WHITE)
        return {c["field"]: _value(F.get(parts, n), c) for n, c in enumerate(step["slots"])}
    if step["op"] == "regex":
        return {g: _value(c, step["captures"][g]) for g, c in _regex(step, text)[0].items()}
    return {k: _value(c, found.cells[k]) for k, c in found.texts.items()}


def _value(text: Column, cell: dict) -> Column:
    return F.when(~text.isin("", *cell.get("null", [])), text)
