"""The closed parser algebra: a specification, as JSON, compiled to a function from bytes to spans.

A parse gives spans over byte ranges: values (semantic), bytes that are kept but not understood (opaque), and syntax
(literal). Every byte of a payload, and of every buffer that a decoder derives from one, is in exactly one span; a parse
that doesn't reach the end, or whose spans overlap, fails. There is no evaluation of code and no operation beyond those
here: a specification is data.

Steps: a list (sequence), or an object with ``op``: literal, regex, csv, kv, positional, quoted, optional, repeated, json,
xml. A value is described by a cell: ``field``, ``class``, ``null`` (texts that mean null), ``opaque``, ``decode`` and
``coerce`` (each with ``on_failure`` reject or opaque; ``decode.then`` parses what was decoded, in a buffer of its own).
"""

from __future__ import annotations

import hashlib
import json
import re
import re._parser as regex_tree
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.functions.values import CLASSES, coerce, decode, is_class

VERSION = "siltline-parser-1"
RAW = "raw"
COERCED = "struct<to:string,v_string:string,v_long:bigint,v_double:double,v_bool:boolean,precision:string,format:int>"
SPAN = f"struct<buffer:string,start:int,stop:int,kind:string,path:string,text:string,class:string,decode_status:string,declared_null:boolean,coerced:{COERCED}>"
PARSED = f"struct<status:string,failure:string,buffers:array<struct<name:string,length:int>>,spans:array<{SPAN}>>"
TARGETS = ("string", "int", "float", "bool", "ip", "ipv4", "ipv6", "mac", "enum", "timestamp")
ENCODINGS = ("base64", "hex", "url", "json-string", "c-escape", "cef-extension")
MOST_DEPTH, MOST_FIELDS, MOST_REPEATS = 32, 2000, 10_000

Run = Callable[["State", "Buffer", int, int, str], int]


class SpecError(ValueError):
    """The specification is refused."""


class Fail(Exception):
    """The payload doesn't fit."""


@dataclass
class Buffer:
    name: str
    data: bytes


@dataclass
class State:
    ingest_ms: int | None = None
    buffers: list[Buffer] = field(default_factory=list)
    spans: list[dict] = field(default_factory=list)

    def mark(self) -> tuple[int, int]:
        return len(self.buffers), len(self.spans)

    def back(self, mark: tuple[int, int]) -> None:
        del self.buffers[mark[0] :], self.spans[mark[1] :]

    def add(self, buffer: Buffer, start: int, stop: int, kind: str, path: str, **more: object) -> dict:
        self.spans.append({"buffer": buffer.name, "start": start, "stop": stop, "kind": kind, "path": path} | more)
        return self.spans[-1]


def child(prefix: str, name: str) -> str:
    return f"{prefix}.{name}" if prefix else name


# ---- cells


def cell_of(spec: dict, where: str, depth: int) -> Callable[[State, Buffer, int, int, str, bytes | None], None]:
    """Emits the span of one value; ``inner`` is its content where this isn't the bytes themselves (a quoted one's)."""
    name = spec.get("field")
    if not name:
        raise SpecError(f"{where}: a cell needs a field")
    opaque, klass, nulls = bool(spec.get("opaque")), spec.get("class", "text"), frozenset(spec.get("null", ()))
    if opaque and ({"class", "coerce", "decode", "null"} & set(spec)):
        raise SpecError(f"{where}: an opaque cell has no class, null, decode or coerce")
    if klass not in CLASSES:
        raise SpecError(f"{where}: unknown class {klass}")
    dec, to = spec.get("decode"), spec.get("coerce")
    then = None
    if dec:
        if dec.get("encoding") not in ENCODINGS:
            raise SpecError(f"{where}: unknown encoding {dec.get('encoding')}")
        then = step_of(dec["then"], f"{where}.then", depth + 1) if "then" in dec else None
    if to:
        if to.get("to") not in TARGETS:
            raise SpecError(f"{where}: unknown target {to.get('to')}")
        if to["to"] == "enum" and not to.get("values") or to["to"] == "timestamp" and not (to.get("format") or to.get("formats")):
            raise SpecError(f"{where}: {to['to']} needs its values or formats")
    for part in (dec, to):
        if part and part.get("on_failure", "reject") not in ("reject", "opaque"):
            raise SpecError(f"{where}: on_failure is reject or opaque")

    def emit(state: State, buffer: Buffer, start: int, stop: int, prefix: str, inner: bytes | None = None) -> None:
        path, raw = child(prefix, name), buffer.data[start:stop] if inner is None else inner
        if not raw:
            return
        if opaque:
            state.add(buffer, start, stop, "opaque", path)
            return
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            state.add(buffer, start, stop, "opaque", path, decode_status="invalid")
            return
        if text in nulls:
            state.add(buffer, start, stop, "semantic", path, text=text, declared_null=True)
            return
        if not is_class(klass, text):
            raise Fail(f"{path}: not {klass}")
        mark = state.mark()
        span = state.add(buffer, start, stop, "semantic", path, text=text, **{"class": klass}, decode_status="ok")
        if dec:
            try:
                out = decode(raw, dec["encoding"])
                if then:
                    derived = Buffer(f"{path}#decoded", out)
                    state.buffers.append(derived)
                    if then(state, derived, 0, len(out), path) != len(out):
                        raise Fail(f"{path}: bytes after what was decoded")
                else:
                    text = span["text"] = out.decode()
            except (ValueError, Fail) as e:
                if dec.get("on_failure", "reject") == "reject":
                    raise Fail(f"{path}: {dec['encoding']}: {e}") from e
                state.back(mark)
                state.add(buffer, start, stop, "opaque", path, decode_status="failed")
                return
        if to:
            got = coerce(text, to, state.ingest_ms)
            if got is None:
                if to.get("on_failure", "reject") == "reject":
                    raise Fail(f"{path}: not {to['to']}")
                state.back(mark)
                state.add(buffer, start, stop, "opaque", path, text=text, decode_status="uncoercible")
                return
            span["coerced"] = got

    return emit


# ---- steps


def step_of(spec: object, where: str = "parse", depth: int = 0) -> Run:
    if depth > MOST_DEPTH:
        raise SpecError(f"{where}: nested too deep")
    if isinstance(spec, list):
        steps = [step_of(s, f"{where}[{n}]", depth + 1) for n, s in enumerate(spec)]

        def sequence(state: State, buffer: Buffer, at: int, end: int, prefix: str) -> int:
            for n, step in enumerate(steps):
                try:
                    at = step(state, buffer, at, end, prefix)
                except Fail as e:
                    raise Fail(f"[{n}] {e}") from e
            return at

        return sequence
    if not isinstance(spec, dict) or spec.get("op") not in OPS:
        raise SpecError(f"{where}: unknown step {spec.get('op') if isinstance(spec, dict) else spec!r}")
    return OPS[spec["op"]](spec, f"{where}.{spec['op']}", depth)


def literal(spec: dict, where: str, depth: int) -> Run:
    text = spec["text"].encode()
    if not text:
        raise SpecError(f"{where}: empty text")

    def run(state: State, buffer: Buffer, at: int, end: int, prefix: str) -> int:
        if not buffer.data.startswith(text, at, end):
            raise Fail(f"expected {spec['text']!r} at {at}")
        return at + len(text)

    return run


REFUSED = {"GROUPREF", "GROUPREF_EXISTS", "ASSERT", "ASSERT_NOT", "ATOMIC_GROUP", "POSSESSIVE_REPEAT"}


def linear_pattern(pattern: str, where: str) -> re.Pattern:
    """The pattern, unless it has what linear-time matching can't offer, or a named group within another."""

    def walk(tree: object, named: bool) -> None:
        for op, arg in tree:
            if str(op) in REFUSED:
                raise SpecError(f"{where}: {op} isn't allowed")
            if str(op) == "SUBPATTERN":
                inner = arg[0] in names
                if inner and named:
                    raise SpecError(f"{where}: a named group within another")
                walk(arg[3], named or inner)
            elif str(op) == "BRANCH":
                for part in arg[1]:
                    walk(part, named)
            elif str(op) in ("MAX_REPEAT", "MIN_REPEAT"):
                walk(arg[2], named)

    try:
        tree = regex_tree.parse(pattern.encode())
        names = set(tree.state.groupdict.values())
        walk(tree, False)
        return re.compile(pattern.encode())
    except re.error as e:
        raise SpecError(f"{where}: {e}") from e


def regex(spec: dict, where: str, depth: int) -> Run:
    pattern = linear_pattern(spec["pattern"], where)
    if set(pattern.groupindex) != set(spec["captures"]):
        raise SpecError(f"{where}: named groups and captures differ")
    cells = [(pattern.groupindex[g], cell_of({"field": g} | c, f"{where}.{g}", depth)) for g, c in spec["captures"].items()]

    def run(state: State, buffer: Buffer, at: int, end: int, prefix: str) -> int:
        m = pattern.match(buffer.data, at, end)
        if not m:
            raise Fail(f"pattern doesn't match at {at}")
        for g, emit in cells:
            if m.start(g) >= 0:
                emit(state, buffer, m.start(g), m.end(g), prefix)
        return m.end()

    return run


def closing(data: bytes, at: int, end: int, quote: bytes, escape: str) -> int:
    """Where the quoted content that starts at ``at`` ends."""
    while at < end:
        if escape == "backslash" and data[at : at + 1] == b"\\":
            at += 2
        elif data.startswith(quote, at, end):
            if escape == "doubled" and data.startswith(quote, at + len(quote), end):
                at += 2 * len(quote)
                continue
            return at
        else:
            at += 1
    raise Fail("quote isn't closed")


def unescaped(raw: bytes, quote: bytes, escape: str) -> bytes:
    if escape == "doubled":
        return raw.replace(quote * 2, quote)
    return re.sub(rb"\\(.)", rb"\1", raw, flags=re.DOTALL) if escape == "backslash" else raw


def quote_of(spec: dict, where: str, default: str = "doubled") -> tuple[bytes, str]:
    escape = spec.get("escape", default)
    if escape not in ("none", "doubled", "backslash"):
        raise SpecError(f"{where}: escape is none, doubled or backslash")
    return spec.get("quote", '"').encode(), escape


def csv(spec: dict, where: str, depth: int) -> Run:
    delimiter, (quote, escape) = spec.get("delimiter", ",").encode(), quote_of(spec, where)
    cells = [cell_of(c, f"{where}[{n}]", depth) for n, c in enumerate(spec["fields"])]
    if len({c["field"] for c in spec["fields"]}) < len(cells) or len(cells) > MOST_FIELDS or not delimiter:
        raise SpecError(f"{where}: fields must differ and have a delimiter")
    extra, missing = spec.get("extra_fields", "opaque"), spec.get("missing_fields", "reject")

    def run(state: State, buffer: Buffer, at: int, end: int, prefix: str) -> int:
        n, data = 0, buffer.data
        while True:
            inner, start = None, at
            if quote and data.startswith(quote, at, end):
                stop = closing(data, at + len(quote), end, quote, escape)
                inner, at = unescaped(data[at + len(quote) : stop], quote, escape), stop + len(quote)
                if at < end and not data.startswith(delimiter, at, end):
                    raise Fail(f"bytes after a closing quote at {at}")
            else:
                at = data.find(delimiter, at, end)
                at = end if at < 0 else at
            if n < len(cells):
                cells[n](state, buffer, start, at, prefix, inner)
            elif extra == "reject":
                raise Fail(f"more than {len(cells)} fields")
            elif at > start:
                state.add(buffer, start, at, "opaque", child(prefix, f"extra.{n - len(cells)}"))
            n += 1
            if at >= end:
                break
            at += len(delimiter)
        if n < len(cells) and missing == "reject":
            raise Fail(f"{n} of {len(cells)} fields")
        return end

    return run


def kv(spec: dict, where: str, depth: int) -> Run:
    pair, equal, (quote, escape) = spec.get("pair_separator", "whitespace_run"), spec.get("key_value_separator", "=").encode(), quote_of(spec, where, "backslash")
    key = linear_pattern(spec.get("key_pattern", r"[A-Za-z_][A-Za-z0-9_.\-]*"), where)
    gap = re.compile(rb"[ \t]+" if pair == "whitespace_run" else re.escape(pair.encode()))
    cells = {k.encode(): cell_of({"field": k} | c, f"{where}.{k}", depth) for k, c in spec["keys"].items()}
    unknown, bare, order = spec.get("unknown_keys", "opaque"), spec.get("allow_bare_keys", False), spec.get("order", "any")
    place = {k: n for n, k in enumerate(cells)}

    def run(state: State, buffer: Buffer, at: int, end: int, prefix: str) -> int:
        data, seen, last = buffer.data, set(), -1
        if pair == "whitespace_run" and (m := gap.match(data, at, end)):
            at = m.end()
        while at < end:
            m = key.match(data, at, end)
            if not m or not m[0]:
                raise Fail(f"no key at {at}")
            name, at = m[0], m.end()
            if data.startswith(equal, at, end):
                at += len(equal)
                start, inner = at, None
                if quote and data.startswith(quote, at, end):
                    stop = closing(data, at + len(quote), end, quote, escape)
                    inner, at = unescaped(data[at + len(quote) : stop], quote, escape), stop + len(quote)
                else:
                    found = gap.search(data, at, end)
                    at = found.start() if found else end
                if name in seen and name in cells:
                    raise Fail(f"key {name.decode()} twice")
                seen.add(name)
                if name in cells:
                    if order == "declared" and place[name] < last:
                        raise Fail(f"key {name.decode()} out of order")
                    last = place[name]
                    cells[name](state, buffer, start, at, prefix, inner)
                elif unknown == "reject":
                    raise Fail(f"unknown key {name.decode()}")
                elif at > start:
                    state.add(buffer, start, at, "opaque", child(prefix, f"unknown.{name.decode()}"))
            elif not bare:
                raise Fail(f"key {name.decode()} without a value")
            if at < end:
                m = gap.match(data, at, end)
                if not m:
                    raise Fail(f"no separator at {at}")
                at = m.end()
        return at

    return run


def positional(spec: dict, where: str, depth: int) -> Run:
    delimiter = spec.get("delimiter", "whitespace_run")
    gap = re.compile(rb"[ \t]+" if delimiter == "whitespace_run" else re.escape(delimiter.encode()))
    slots = []
    for n, slot in enumerate(spec["slots"]):
        name = f"{where}[{n}]"
        slots.append(("step", step_of(slot["step"], name, depth + 1)) if "step" in slot else ("parse", step_of(slot["parse"], name, depth + 1)) if "parse" in slot else ("cell", cell_of(slot, name, depth)))
    tail = cell_of(spec["tail"], f"{where}.tail", depth) if "tail" in spec else None
    leading, trailing = spec.get("leading", "reject"), spec.get("trailing", "reject")

    def run(state: State, buffer: Buffer, at: int, end: int, prefix: str) -> int:
        data = buffer.data
        if m := gap.match(data, at, end):
            if leading == "reject":
                raise Fail("delimiter before the first slot")
            at = m.end()
        for n, (kind, slot) in enumerate(slots):
            if n:
                m = gap.match(data, at, end)
                if not m:
                    raise Fail(f"no delimiter before slot {n} at {at}")
                at = m.end()
            if kind == "step":
                at = slot(state, buffer, at, end, prefix)
                continue
            m = gap.search(data, at, end)
            stop = m.start() if m else end
            if stop == at:
                raise Fail(f"slot {n} is empty at {at}")
            if kind == "cell":
                slot(state, buffer, at, stop, prefix)
            elif slot(state, buffer, at, stop, prefix) != stop:
                raise Fail(f"slot {n} isn't used up")
            at = stop
        if tail:
            if (m := gap.match(data, at, end)) and m.end() > m.start():
                at = m.end()
            tail(state, buffer, at, end, prefix)
            return end
        if trailing == "allow" and (m := gap.match(data, at, end)):
            at = m.end()
        return at

    return run


def quoted(spec: dict, where: str, depth: int) -> Run:
    start_, stop_ = spec.get("open", '"').encode(), spec.get("close", spec.get("open", '"')).encode()
    _, escape = quote_of({"escape": spec.get("escape", "none")}, where)
    cell = cell_of(spec["content"], where, depth) if "content" in spec else None
    inner_step = step_of(spec["parse"], where, depth + 1) if "parse" in spec else None
    if (cell is None) == (inner_step is None):
        raise SpecError(f"{where}: content or parse")

    def run(state: State, buffer: Buffer, at: int, end: int, prefix: str) -> int:
        data = buffer.data
        if not data.startswith(start_, at, end):
            raise Fail(f"no opening quote at {at}")
        at += len(start_)
        stop = closing(data, at, end, stop_, escape)
        raw = data[at:stop]
        plain = unescaped(raw, stop_, escape)
        if cell:
            cell(state, buffer, at, stop, prefix, plain)
        elif plain == raw:
            if inner_step(state, buffer, at, stop, prefix) != stop:
                raise Fail("quoted content isn't used up")
        else:
            path = child(prefix, spec.get("field", "quoted"))
            derived = Buffer(f"{path}#decoded", plain)
            state.buffers.append(derived)
            state.add(buffer, at, stop, "semantic", path, text=raw.decode(errors="replace"))
            if inner_step(state, derived, 0, len(plain), prefix) != len(plain):
                raise Fail("quoted content isn't used up")
        return stop + len(stop_)

    return run


def optional(spec: dict, where: str, depth: int) -> Run:
    step = step_of(spec["step"], where, depth + 1)

    def run(state: State, buffer: Buffer, at: int, end: int, prefix: str) -> int:
        mark = state.mark()
        try:
            return step(state, buffer, at, end, prefix)
        except Fail:
            state.back(mark)
            return at

    return run


def repeated(spec: dict, where: str, depth: int) -> Run:
    step, separator = step_of(spec["step"], where, depth + 1), spec.get("separator", "").encode()
    least, most = spec.get("min", 0), spec.get("max", MOST_REPEATS)
    if not 0 <= least <= most <= MOST_REPEATS:
        raise SpecError(f"{where}: min and max")

    def run(state: State, buffer: Buffer, at: int, end: int, prefix: str) -> int:
        n = 0
        while n < most:
            mark, start = state.mark(), at
            try:
                if n and separator:
                    if not buffer.data.startswith(separator, at, end):
                        break
                    start += len(separator)
                got = step(state, buffer, start, end, f"{prefix}[{n}]")
            except Fail:
                state.back(mark)
                break
            if got == at:
                state.back(mark)
                break
            at, n = got, n + 1
        if n < least:
            raise Fail(f"{n} of at least {least} repeats")
        return at

    return run


JSON_TOKEN = re.compile(rb'[ \t\r\n]*(?:([{}\[\],:])|"((?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*)"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))')


def unknown_path(path: str) -> str:
    return "unknown." + re.sub(r"[^A-Za-z0-9_.\-]", "_", path)


def json_op(spec: dict, where: str, depth: int) -> Run:
    cells = {k: cell_of({"field": k} | c, f"{where}.{k}", depth) for k, c in spec["keys"].items()}
    unknown = spec.get("unknown_keys", "opaque")

    def run(state: State, buffer: Buffer, at: int, end: int, prefix: str) -> int:
        data, seen = buffer.data, set()

        def token(at: int) -> re.Match:
            m = JSON_TOKEN.match(data, at, end)
            if not m:
                raise Fail(f"not JSON at {at}")
            return m

        def skip(at: int, deep: int) -> int:
            """Past the value that starts at ``at``."""
            if deep > MOST_DEPTH:
                raise Fail("nested too deep")
            m = token(at)
            if m[1] not in (b"{", b"["):
                if m[1]:
                    raise Fail(f"no value at {at}")
                return m.end()
            close = b"}" if m[1] == b"{" else b"]"
            at = m.end()
            if token(at)[1] == close:
                return token(at).end()
            while True:
                if close == b"}":
                    key = token(at)
                    if key[1] or key[3] or token(key.end())[1] != b":":
                        raise Fail(f"no key at {at}")
                    at = token(key.end()).end()
                at = skip(at, deep + 1)
                m = token(at)
                at = m.end()
                if m[1] == close:
                    return at
                if m[1] != b",":
                    raise Fail(f"no comma at {at}")

        def value(at: int, path: str, deep: int) -> int:
            m = token(at)
            if m[1] == b"{" and path not in cells:
                return obj(m.end(), path, deep + 1)
            stop = skip(at, deep)
            start, inner = m.start() + len(m[0]) - len(m[0].lstrip()), None
            string = m[1] is None and m[3] is None
            if string:
                start, last = start + 1, stop - 1
                inner = json.loads(data[start - 1 : stop]).encode(errors="surrogatepass") if b"\\" in data[start:last] else None
            else:
                last = stop
            if path in cells:
                if path in seen:
                    raise Fail(f"key {path} twice")
                seen.add(path)
                if m[3] == b"null":
                    state.add(buffer, start, last, "semantic", child(prefix, path), text="null", declared_null=True)
                else:
                    cells[path](state, buffer, start, last, prefix, inner)
            elif unknown == "reject":
                raise Fail(f"unknown key {path}")
            elif last > start:
                state.add(buffer, start, last, "opaque", child(prefix, unknown_path(path)))
            return stop

        def obj(at: int, path: str, deep: int) -> int:
            if deep > MOST_DEPTH:
                raise Fail("nested too deep")
            if token(at)[1] == b"}":
                return token(at).end()
            while True:
                key = token(at)
                if key[1] or key[3] is not None:
                    raise Fail(f"no key at {at}")
                name = json.loads(key[0].strip()).replace(".", "\\.")
                colon = token(key.end())
                if colon[1] != b":":
                    raise Fail(f"no colon at {key.end()}")
                at = value(colon.end(), f"{path}.{name}" if path else name, deep)
                m = token(at)
                at = m.end()
                if m[1] == b"}":
                    return at
                if m[1] != b",":
                    raise Fail(f"no comma at {at}")

        m = token(at)
        if m[1] != b"{":
            raise Fail("not a JSON object")
        at = obj(m.end(), "", 1)
        return at + len(data[at:end]) - len(data[at:end].lstrip(b" \t\r\n"))

    return run


XML_TOKEN = re.compile(rb"<!--.*?-->|<\?.*?\?>|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<!DOCTYPE[^>]*>|</(?P<close>[\w:.-]+)\s*>|<(?P<open>[\w:.-]+)(?P<attrs>(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(?P<empty>/?)>|(?P<text>[^<]+)", re.DOTALL)
XML_ATTR = re.compile(rb"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def xml_op(spec: dict, where: str, depth: int) -> Run:
    cells = {k: cell_of({"field": k.replace("/", ".").replace("@", ".")} | c, f"{where}.{k}", depth) for k, c in spec["paths"].items()}
    unknown = spec.get("unknown", "opaque")

    def run(state: State, buffer: Buffer, at: int, end: int, prefix: str) -> int:
        data, stack, seen, mixed = buffer.data, [], set(), set()

        def value(path: str, start: int, stop: int) -> None:
            if path in cells:
                if path in seen:
                    raise Fail(f"{path} twice")
                seen.add(path)
                cells[path](state, buffer, start, stop, prefix)
            elif unknown == "reject":
                raise Fail(f"unknown path {path}")
            elif stop > start:
                state.add(buffer, start, stop, "opaque", child(prefix, unknown_path(path)))

        done = False
        while at < end:
            m = XML_TOKEN.match(data, at, end)
            if not m:
                raise Fail(f"not XML at {at}")
            path = "/".join(stack)
            if m["text"] is not None or m["cdata"] is not None:
                group = "text" if m["text"] is not None else "cdata"
                start, stop = m.span(group)
                if group == "text":
                    start += len(m[group]) - len(m[group].lstrip())
                    stop = start + len(m[group].strip())
                if stop > start:
                    if not stack:
                        raise Fail("text outside the root")
                    if path in cells and path in mixed:
                        raise Fail(f"{path} has text and elements")
                    value(path, start, stop)
            elif m["open"]:
                if done:
                    raise Fail("two roots")
                if path in cells and path in seen:
                    raise Fail(f"{path} has text and elements")
                mixed.add(path)
                stack.append(m["open"].decode())
                if len(stack) > MOST_DEPTH:
                    raise Fail("nested too deep")
                for a in XML_ATTR.finditer(data, *m.span("attrs")):
                    g = 2 if a[2] is not None else 3
                    value(f"{'/'.join(stack)}@{a[1].decode()}", *a.span(g))
                if m["empty"]:
                    stack.pop()
            elif m["close"]:
                if not stack or stack.pop().encode() != m["close"]:
                    raise Fail(f"unexpected end tag at {at}")
            at = m.end()
            done = done or bool(m["open"] or m["close"]) and not stack
        if stack or not done:
            raise Fail("an element isn't closed")
        return at

    return run


OPS = {"literal": literal, "regex": regex, "csv": csv, "kv": kv, "positional": positional, "quoted": quoted, "optional": optional, "repeated": repeated, "json": json_op, "xml": xml_op}


# ---- programs


def tiles(spans: list[dict], buffers: list[Buffer]) -> list[dict]:
    """The spans in order, with literals for the syntax between them; ``Fail`` on an overlap."""
    out = []
    for buffer in sorted(buffers, key=lambda b: (b.name != RAW, b.name)):
        at = 0
        for s in sorted((s for s in spans if s["buffer"] == buffer.name), key=lambda s: (s["start"], s["stop"])):
            if s["start"] < at:
                raise Fail(f"spans overlap in {buffer.name} at {s['start']}")
            if s["start"] > at:
                out.append({"buffer": buffer.name, "start": at, "stop": s["start"], "kind": "literal", "path": None})
            out.append(s)
            at = s["stop"]
        if at < len(buffer.data):
            out.append({"buffer": buffer.name, "start": at, "stop": len(buffer.data), "kind": "literal", "path": None})
    return out


class Program:
    """A compiled specification."""

    def __init__(self, spec: dict):
        self.spec, self.id, self.most = spec, spec.get("id", ""), spec.get("max_event_bytes", 1 << 16)
        if not 1 <= self.most <= 1 << 24:
            raise SpecError("max_event_bytes")
        self.run = step_of(spec["parse"])
        # What decides a parse: two programs of one hash give equal spans and refuse the same events.
        canonical = json.dumps({"parse": spec["parse"], "max_event_bytes": self.most}, sort_keys=True, separators=(",", ":"))
        self.dsl_hash = "sha256:" + hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        self.parser_hash = "sha256:" + hashlib.sha256(f"{VERSION}\n{canonical}".encode()).hexdigest()

    def parse(self, data: bytes, ingest_ms: int | None = None) -> dict:
        """status ok with all spans, or failed with the reason and none."""
        state = State(ingest_ms, [Buffer(RAW, data)])
        try:
            if len(data) > self.most:
                raise Fail(f"event of {len(data)} bytes is over {self.most}")
            at = self.run(state, state.buffers[0], 0, len(data), "")
            if at != len(data):
                raise Fail(f"bytes after the end at {at}")
            spans = tiles(state.spans, state.buffers)
        except Fail as e:
            return {"status": "failed", "failure": str(e), "buffers": [], "spans": []}
        return {"status": "ok", "failure": None, "buffers": [{"name": b.name, "length": len(b.data)} for b in state.buffers], "spans": spans}


KINDS = {bool: "v_bool", int: "v_long", float: "v_double", str: "v_string"}


def _row(parsed: dict) -> dict:
    def one(s: dict) -> dict:
        c = s.get("coerced")
        return s | ({"coerced": {"to": c["to"], KINDS[type(c["value"])]: c["value"], "precision": c.get("precision"), "format": c.get("format")}} if c else {})

    return parsed | {"spans": [one(s) for s in parsed["spans"]]}


def parse(df: DataFrame, spec: dict, payload: str = "payload", ingest_ms: str | None = None, into: str = "parsed") -> DataFrame:
    """``df`` with the parse of its column ``payload`` (binary or string); a null payload is empty. One pass in Arrow batches."""
    Program(spec)  # refused here rather than on executors
    if into in df.columns:
        raise ValueError(f"there is a column {into}")
    # The input passes as one struct, so that names and types don't matter.
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(payload).cast("binary").alias("payload"), (F.col(ingest_ms) if ingest_ms else F.lit(None)).cast("long").alias("ms"))
    schema = rows.select("row", F.lit(None).cast(PARSED).alias(into)).schema
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(schema[into].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program = Program(spec)
        for b in batches:
            out = [_row(program.parse(raw or b"", ms)) for raw, ms in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["row", into])

    return rows.mapInArrow(run, schema).select("row.*", into)


def texts(parsed: str = "parsed", last: bool = False):
    """A map from path to text of the semantic spans; of equal paths the first (or last) wins."""
    ours = F.filter(F.col(f"{parsed}.spans"), lambda s: (s["kind"] == "semantic") & F.coalesce(~s["declared_null"], F.lit(True)) & s["path"].isNotNull())
    ours = F.reverse(ours) if last else ours
    paths = F.transform(ours, lambda s: s["path"])
    first = F.filter(ours, lambda s, i: F.array_position(paths, s["path"]) == i + 1)
    return F.map_from_entries(F.transform(first, lambda s: F.struct(s["path"], s["text"])))
