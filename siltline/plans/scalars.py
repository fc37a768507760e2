"""Queries that put single functions and steps of the parser to the test of SQL: times, decoders, quotes, repeats, envelopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltline.functions import columns as C
from siltline.operators import envelopes, normalize, parser
from siltline.plans.analytics import ms, table
from siltline.plans.roundtrips import INT, s, text, value

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query("SELECT event_id, concat('ev_', lpad(CAST(event_id AS VARCHAR), 26, '0')) AS id FROM events")
def event_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", C.event_id("event_id").alias("id"))


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '+00:00' WHEN 1 THEN '+05:30' WHEN 2 THEN '-11:00' WHEN 3 THEN '+14:00' END AS utc FROM customer")
def utc_offsets(spark, sf_dir):
    """Offsets in one form; over 14 hours, or 60 minutes and more, there is none."""
    said = F.get(F.array(*map(F.lit, ("Z", "+0530", "-11:00", "+1400", "+14:01", "+05:75"))), (F.col("c_custkey") % 6).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.utc_offset(said).alias("utc"))


@query("SELECT event_id, epoch_us(ts) // 1000000 * 1000 AS of_date, epoch_us(ts) // 1000000 * 1000 - 19800000 AS of_zone FROM events")
def composed_datetimes(spark, sf_dir):
    """Date and time from two values, in UTC and at an offset from a third."""
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("d"), F.date_format("ts", "HH:mm:ss").alias("t"), F.lit("+0530").alias("z"))
    return e.select("event_id", normalize.compose_datetime(F.col("d"), F.col("t")).alias("of_date"), normalize.compose_datetime(F.col("d"), F.col("t"), F.col("z")).alias("of_zone"))


@query("WITH e AS (SELECT event_id, epoch_us(ts) AS us, value FROM events) SELECT event_id, us // 1000000 * 1000 AS of_s, us // 1000 AS of_ms, us // 1000 AS of_us, us // 1000 AS of_ns, -((us // 1000)) AS before, CAST(round(value * 1000) AS BIGINT) AS of_frac FROM e")
def epoch_units(spark, sf_dir):
    """Every unit to milliseconds, whole numbers towards zero, fractions rounded."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("event_id", us.alias("us"), "value").withColumn("whole", (F.col("us") - F.col("us") % 1_000_000) / F.lit(1_000_000).cast("decimal(20,0)"))
    return e.select("event_id", C.epoch(F.col("whole").cast("long"), "s").alias("of_s"), C.epoch((F.col("us") - F.col("us") % 1000) / F.lit(1000).cast("decimal(20,0)"), "ms").cast("long").alias("of_ms"), C.epoch("us", "us").alias("of_us"), C.epoch(F.col("us") * 1000, "ns").alias("of_ns"), C.epoch(-F.col("us"), "us").alias("before"), C.epoch_frac("value").alias("of_frac"))


def _at(**form) -> dict:
    return {"coerce": {"to": "timestamp", **form}}


TIMES = {"id": "times", "parse": {"op": "csv", "fields": [
    {"field": "rfc3339"} | _at(format={"kind": "rfc3339"}), {"field": "offset"} | _at(format={"kind": "rfc3339"}), {"field": "pattern"} | _at(format={"kind": "pattern", "pattern": "%d/%b/%Y:%H:%M:%S"}),
    {"field": "rfc3164"} | _at(format={"kind": "rfc3164"}), {"field": "frac"} | _at(format={"kind": "epoch_s_frac"}), {"field": "ordered"} | _at(formats=[{"kind": "epoch_s"}, {"kind": "pattern", "pattern": "%Y-%j %I:%M:%S %p"}]),
    {"field": "none"} | {"coerce": {"to": "timestamp", "format": {"kind": "pattern", "pattern": "%Y-%m-%d"}, "on_failure": "opaque"}},
]}}


@query("WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS t FROM events) SELECT event_id, t AS rfc3339, t - 5400000 AS \"offset\", t // 1000 * 1000 AS pattern, t // 1000 * 1000 AS rfc3164, t AS frac, t // 1000 * 1000 AS ordered, event_id % 2 AS of_format, 'uncoercible' AS state FROM e")
def timestamps(spark, sf_dir):
    """Times as texts in every kind, through the parser; a date that doesn't exist stays opaque."""
    t, at = F.col("ts"), ms()
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    ordered = F.when(F.col("event_id") % 2 == 0, F.floor(at / 1000).cast("string")).otherwise(F.date_format(t, "yyyy-DDD hh:mm:ss a"))
    line = F.concat_ws(",", F.concat(whole, F.lit("Z")), F.concat(whole, F.lit("+01:30")), F.date_format(t, "dd/MMM/yyyy:HH:mm:ss"), F.date_format(t, "MMM dd HH:mm:ss"), F.concat(F.floor(at / 1000).cast("string"), F.lit("."), F.lpad((at % 1000).cast("string"), 3, "0")), ordered, F.lit("2023-02-30"))
    p = parser.parse(table(spark, sf_dir, "events").select("event_id", line.alias("payload"), at.alias("at")), TIMES, ingest_ms="at")
    one = lambda path: F.get(F.filter("parsed.spans", lambda x: x["path"] == path), 0)
    return p.select("event_id", *(value(c, "v_long").alias(c) for c in ("rfc3339", "offset", "pattern", "rfc3164", "frac", "ordered")), one("ordered")["coerced"]["format"].cast("long").alias("of_format"), one("none")["decode_status"].alias("state"))


DECODED = {"id": "decoded", "parse": {"op": "csv", "fields": [{"field": k, "decode": {"encoding": e}} for k, e in (("b64", "base64"), ("hexed", "hex"), ("url", "url"), ("json", "json-string"), ("c", "c-escape"), ("cef", "cef-extension"))] + [{"field": "pair", "decode": {"encoding": "base64", "then": [{"op": "kv", "keys": {"n": INT, "brand": {}}}]}}, {"field": "bad", "decode": {"encoding": "hex", "on_failure": "opaque"}}]}}


@query("SELECT p_partkey, p_name AS b64, p_name AS hexed, concat(p_name, '+') AS url, concat(p_name, chr(9), 'é') AS json, concat(p_name, 'A', chr(10)) AS c, concat(p_name, '=', chr(92)) AS cef, p_partkey AS n, p_brand AS brand, 'failed' AS state FROM part")
def decode_steps(spark, sf_dir):
    """Values decoded in every encoding, one of them parsed again in a buffer of its own; what isn't of its encoding stays opaque."""
    p = table(spark, sf_dir, "part")
    b64 = lambda c: F.base64(c.cast("binary"))
    name = F.col("p_name")
    cells = (b64(name), F.hex(name.cast("binary")), F.concat(F.replace(name, F.lit(" "), F.lit("%20")), F.lit("+")), F.concat(name, F.lit("\\t\\u00e9")), F.concat(name, F.lit("\\x41\\n")), F.concat(name, F.lit("\\=\\\\")), b64(F.concat(F.lit("n="), s("p_partkey"), F.lit(" brand="), "p_brand")), F.lit("xyz"))
    q = parser.parse(p.select("p_partkey", F.concat_ws(",", *cells).alias("payload")), DECODED)
    bad = F.get(F.filter("parsed.spans", lambda x: x["path"] == "bad"), 0)
    return q.select("p_partkey", *(text(c).alias(c) for c in ("b64", "hexed", "url", "json", "c", "cef")), value("pair.n", "v_long").alias("n"), text("pair.brand").alias("brand"), bad["decode_status"].alias("state"))


STEPS = {"id": "steps", "parse": [{"op": "literal", "text": "<<"}, {"op": "quoted", "escape": "backslash", "content": {"field": "name"}}, {"op": "literal", "text": " ["}, {"op": "repeated", "separator": ";", "min": 1, "max": 4, "step": {"op": "regex", "pattern": "(?P<n>[0-9]+)", "captures": {"n": INT}}}, {"op": "literal", "text": "]>>"}]}


@query("SELECT p_partkey, CASE WHEN p_size % 5 < 4 THEN concat(p_name, ' \"x\"') END AS name, CASE WHEN p_size % 5 < 4 THEN 1 + p_size % 5 ELSE 0 END AS repeats, CASE WHEN p_size % 5 < 4 THEN (1 + p_size % 5) * (2 + p_size % 5) // 2 * 10 ELSE 0 END AS total, CASE WHEN p_size % 5 < 4 THEN 'ok' ELSE 'failed' END AS status FROM part")
def sequence_steps(spark, sf_dir):
    """Literals, a quoted value with escapes, and one to four repeats; a fifth isn't expected."""
    p = table(spark, sf_dir, "part")
    numbers = F.array_join(F.transform(F.sequence(F.lit(1), (1 + F.col("p_size") % 5).cast("int")), lambda n: (n * 10).cast("string")), ";")
    line = F.concat(F.lit('<<"'), "p_name", F.lit(' \\"x\\"" ['), numbers, F.lit("]>>"))
    q = parser.parse(p.select("p_partkey", line.alias("payload")), STEPS)
    own = F.filter("parsed.spans", lambda x: x["coerced"]["v_long"].isNotNull())
    return q.select("p_partkey", text("name").alias("name"), F.size(own).cast("long").alias("repeats"), F.aggregate(own, F.lit(0).cast("long"), lambda n, x: n + x["coerced"]["v_long"]).alias("total"), F.col("parsed.status").alias("status"))


@query("SELECT event_id, event_id % 192 AS priority, event_id % 192 // 8 AS facility, event_id % 192 % 8 AS severity, concat('h', user_id) AS hostname, event_type AS app_name, NULL AS proc_id, '2024-01-01T00:09:58Z' AS timestamp FROM events")
def envelope_values(spark, sf_dir):
    """Header fields of the innermost envelope; a dash is no value."""
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit("<"), (F.col("event_id") % 192).cast("string"), F.lit(">1 2024-01-01T00:09:58Z h"), s("user_id"), F.lit(" "), "event_type", F.lit(" - - - "), "props")
    u = envelopes.unwrap(e.select("event_id", line.alias("raw")))
    numbers = (envelopes.envelope_value(c).cast("long").alias(c) for c in ("priority", "facility", "severity"))
    return u.select("event_id", *numbers, *(envelopes.envelope_value(c).alias(c) for c in ("hostname", "app_name", "proc_id", "timestamp")))
