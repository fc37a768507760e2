"""The scalar functions that Spark's own expressions can state, as Columns: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltline.functions.values import CLASSES, PRECISIONS, SPAN_S

OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^({OCTET}\.){{3}}{OCTET}$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_class(name: str, text: Column | str) -> Column:
    """Structural class; of addresses only IPv4 is checked in full here (``parser`` parses IPv6 too)."""
    return col(text).rlike(IPV4 if name == "ipv4" else rf"^(?:{CLASSES[name]})\z")


def token_class(text: Column | str) -> Column:
    """The router's first match: integer, float, ipv4, url, word, text."""
    t = col(text)
    return (
        F.when(t.rlike(r"^-?[0-9]+$"), "integer")
        .when(t.rlike(r"^-?[0-9]+\.[0-9]+$"), "float")
        .when(t.rlike(IPV4), "ipv4")
        .when(t.contains("://") | t.rlike(r"^[A-Za-z0-9.\-]+:[0-9]+$"), "url")
        .when(t.rlike(r"^[A-Za-z0-9_.:\-]+$"), "word")
        .otherwise("text")
    )


def to_int(text: Column | str) -> Column:
    t = col(text)
    return F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))


def to_float(text: Column | str) -> Column:
    t = col(text)
    x = t.try_cast("double")
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$") & (F.abs(x) < float("inf")), x)


def to_bool(text: Column | str) -> Column:
    low = F.lower(col(text))
    return F.when(low.isin("true", "1", "yes", "on"), True).when(low.isin("false", "0", "no", "off"), False)


def to_enum(text: Column | str, values: list[str]) -> Column:
    return F.when(col(text).isin(*values), col(text))


def to_mac(text: Column | str) -> Column:
    return F.when(is_class("mac", text), F.lower(F.replace(col(text), F.lit("-"), F.lit(":"))))


def to_ipv4(text: Column | str) -> Column:
    return F.when(is_class("ipv4", text), col(text))


def ipv4_number(text: Column | str) -> Column:
    parts = F.split(to_ipv4(text), r"\.")
    return sum((F.get(parts, k).cast("bigint") * (1 << 8 * (3 - k)) for k in range(1, 4)), F.get(parts, 0).cast("bigint") * (1 << 24))


def in_cidr(text: Column | str, cidr: str) -> Column:
    import ipaddress

    net = ipaddress.IPv4Network(cidr)
    return ipv4_number(text).between(int(net.network_address), int(net.broadcast_address))


def epoch(number: Column | str, unit: str) -> Column:
    n, scale = col(number), PRECISIONS[unit]
    return F.try_multiply(n, F.lit(1000)) if scale == 1 else _div(n, scale // 1000)


def _div(n: Column, by: int) -> Column:
    """Integer division towards zero."""
    return n if by == 1 else ((n - n % by) / F.lit(by).cast("decimal(20,0)")).cast("bigint")


def epoch_frac(x: Column | str) -> Column:
    return F.round(col(x) * 1000).cast("bigint")


def epoch_precision(number: Column | str) -> Column:
    """The one precision that puts the number in 2000 to 2100; null if none does."""
    n, out = col(number), F.lit(None).cast("string")
    for unit, scale in PRECISIONS.items():
        out = F.when((n >= SPAN_S[0] * scale) & (n < SPAN_S[1] * scale), unit).otherwise(out)
    return out


def epoch_auto(number: Column | str) -> Column:
    # Bound as a lambda's argument, the number is computed once and not for each comparison.
    def of(n: Column) -> Column:
        out = F.lit(None).cast("bigint")
        for unit, scale in PRECISIONS.items():
            out = F.when((n >= SPAN_S[0] * scale) & (n < SPAN_S[1] * scale), epoch(n, unit)).otherwise(out)
        return out

    return F.get(F.transform(F.array(col(number)), of), 0)


def event_day(ms: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(F.coalesce(col(ms), F.lit(0))), "yyyyMMdd")


def utc_offset(text: Column | str) -> Column:
    """Z, +HHMM or +HH:MM up to 14 hours as +HH:MM."""
    t = col(text)
    sign, hours, minutes = (F.regexp_extract(t, r"^([+-])(\d\d):?(\d\d)$", k) for k in (1, 2, 3))
    fits = (F.coalesce(minutes.try_cast("int"), F.lit(60)) <= 59) & (hours.try_cast("int") * 60 + minutes.try_cast("int") <= 840)
    return F.when(t == "Z", "+00:00").when(fits, F.concat(sign, hours, F.lit(":"), minutes))


def evidence_hash(raw: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col(raw).cast("binary"), 256))


def event_id(sequence: Column | str) -> Column:
    return F.concat(F.lit("ev_"), F.lpad(col(sequence).cast("string"), 26, "0"))


def fnv1a(text: Column | str) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    digits = F.hex(F.encode(col(text), "UTF-8"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.length(digits) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(2166136261).cast("bigint"), lambda h, i: (h.bitwiseXOR(F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("bigint")) * 16777619) % (1 << 32))


def shard(name: Column | str, n: int) -> Column:
    """The shard of a file name: by what is before its first underscore."""
    return fnv1a(F.substring_index(col(name), "_", 1)) % n


def host_of(peer: Column | str) -> Column:
    return F.regexp_replace(col(peer), ":[^:]*$", "")


def arity_bucket(n: Column | str, size: int = 20) -> Column:
    return (F.floor(col(n) / size) * size).cast("bigint")


def unescape(text: Column | str, quote: str, escape: str) -> Column:
    t = col(text)
    if escape == "doubled":
        return F.replace(t, F.lit(quote * 2), F.lit(quote))
    return F.regexp_replace(t, r"\\(.)", "$1") if escape == "backslash" else t


def decode(text: Column | str, encoding: str) -> Column:
    """base64, hex and url as binary; null if the text isn't of this encoding."""
    t = col(text)
    if encoding in ("base64", "hex"):
        return F.try_to_binary(t, F.lit(encoding))
    if encoding == "url":
        return F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))).cast("binary")
    if encoding == "json-string":
        return F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), t, F.lit('"'))), "$", "string").cast("binary")
    raise ValueError(f"{encoding} needs the parser")


def lookup(text: Column | str, table: dict[str, str], default: str | None = None) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv)) if table else F.lit(None).cast("map<string,string>")
    return F.coalesce(F.try_element_at(pairs, col(text)), F.lit(default))


def cef_header(c: Column) -> Column:
    return F.translate(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), "\n\r", "  ")


def cef_value(c: Column) -> Column:
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("="), F.lit("\\="))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def cef_severity(severity_id: Column) -> Column:
    return F.when(severity_id >= 0, F.least(severity_id * 2, F.lit(10))).otherwise(3)


def cef(class_uid: Column, name: Column, activity: Column, severity: Column, extension: dict[str, Column], vendor: str = "siltline", product: str = "siltline") -> Column:
    """A CEF record; extensions that are null or empty are left out."""
    pairs = [F.when(F.length(c.cast("string")) > 0, F.concat(F.lit(f"{k}="), cef_value(c.cast("string")))) for k, c in extension.items()]
    title = cef_header(F.concat(F.coalesce(name, F.concat(F.lit("ocsf class "), class_uid.cast("string"))), F.lit("/"), activity.cast("string")))
    return F.concat(F.lit(f"CEF:0|{vendor}|{product}|1.0|"), class_uid.cast("string"), F.lit("|"), title, F.lit("|"), cef_severity(severity).cast("string"), F.lit("|"), F.concat_ws(" ", *pairs))


def sd_value(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("]"), F.lit("\\]"))


def rfc5424(ms: Column, host: Column, identity: dict[str, Column], message: Column, app: str = "siltline", sd: str = "siltline@32473") -> Column:
    when = F.when(ms > 0, F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise("-")
    pairs = [F.concat(F.lit(f'{k}="'), sd_value(c.cast("string")), F.lit('"')) for k, c in identity.items()]
    head = F.concat(F.lit("<134>1 "), when, F.lit(" "), F.coalesce(F.nullif(host, F.lit("")), F.lit("-")), F.lit(f" {app} - ocsf "))
    return F.concat(head, F.lit(f"[{sd} "), F.concat_ws(" ", *pairs), F.lit("] "), message)


def hec(ms: Column, host: Column, event: Column, source: str = "siltline", sourcetype: str = "ocsf") -> Column:
    return F.to_json(F.struct((ms / 1000).alias("time"), host.alias("host"), F.lit(source).alias("source"), F.lit(sourcetype).alias("sourcetype"), event.alias("event")))


def bulk(event_id: Column, class_uid: Column, document: Column, index: str = "events-{class_uid}") -> Column:
    """An upsert by event id: action line, document line."""
    before, _, after = index.partition("{class_uid}")
    name = F.concat(F.lit(before), class_uid.cast("string"), F.lit(after)) if "{class_uid}" in index else F.lit(index)
    return F.concat(F.to_json(F.struct(F.struct(name.alias("_index"), event_id.alias("_id")).alias("index"))), F.lit("\n"), document, F.lit("\n"))


def merkle_leaf(segment: Column, offset: Column, length: Column, raw_hash: Column, label: str = "siltline-leaf-v1") -> Column:
    """Hex SHA-256 of 0x00, label, segment, offset (8 bytes), length (4 bytes) and the raw hash (32 bytes)."""
    number = lambda c, n: F.unhex(F.lpad(F.hex(c.cast("bigint")), n, "0"))
    return F.sha2(F.concat(F.unhex(F.lit("00")), F.encode(F.lit(label), "UTF-8"), F.encode(segment, "UTF-8"), number(offset, 16), number(length, 8), F.unhex(F.replace(raw_hash, F.lit("sha256:"), F.lit("")))), 256)
