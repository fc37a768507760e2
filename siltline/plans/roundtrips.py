"""Queries that render device lines from tables, put them through framing, envelopes, routing and parsing, and read values back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.functions import columns as C
from siltline.operators import envelopes, normalize, parser, provenance, routing
from siltline.plans import fastpath
from siltline.plans.analytics import HOST, host, ms, spread, table
from siltline.sources import frames

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def s(c: str) -> Column:
    return F.col(c).cast("string")


def text(path: str, parsed: str = "parsed") -> Column:
    return F.get(F.filter(F.col(f"{parsed}.spans"), lambda x: x["path"] == path), 0)["text"]


def value(path: str, kind: str, parsed: str = "parsed") -> Column:
    return F.get(F.filter(F.col(f"{parsed}.spans"), lambda x: x["path"] == path), 0)["coerced"][kind]


INT = {"class": "integer", "coerce": {"to": "int"}}
KV_SPEC = {"id": "kv", "parse": {"op": "kv", "keys": {"id": INT, "time": {"class": "integer", "coerce": {"to": "timestamp", "format": {"kind": "epoch_auto"}}}, "user": INT, "type": {"class": "word"}, "src": {"class": "ipv4", "coerce": {"to": "ipv4"}}, "value": {"class": "float", "coerce": {"to": "float"}}}}}


def kv_line() -> Column:
    return F.concat(F.lit("id="), s("event_id"), F.lit(" time="), ms().cast("string"), F.lit(" user="), s("user_id"), F.lit(" type="), F.col("event_type"), F.lit(" src="), host(), F.lit(" value="), F.format_string("%.2f", "value"))


def kv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "events")).select("event_id", kv_line().alias("payload"))


@query(f"SELECT event_id AS id, epoch_us(ts) // 1000 AS time_ms, user_id AS user, event_type AS type, {HOST} AS src, round(value, 2) AS value FROM events")
def kv_roundtrip(spark, sf_dir):
    """Values by the fast path; lines that don't fit it (none here) by the parser."""
    return fastpath.values(kv_lines(spark, sf_dir), KV_SPEC, {"id": "id", "time_ms": "time", "user": "user", "type": "type", "src": "src", "value": "value"})


@query(f"SELECT event_id AS id, epoch_us(ts) // 1000 AS time_ms, user_id AS user, event_type AS type, {HOST} AS src, round(value, 2) AS value FROM events")
def kv_fast_path(spark, sf_dir):
    """The same for lines that are known to fit: the specification as native expressions alone."""
    v = fastpath.columns(KV_SPEC, "payload")
    lines = kv_lines(spark, sf_dir).select(*(c.alias(k) for k, c in v.items()))
    return lines.select(C.to_int("id").alias("id"), C.epoch_auto(C.to_int("time")).alias("time_ms"), C.to_int("user").alias("user"), "type", C.to_ipv4("src").alias("src"), C.to_float("value").alias("value"))


@query(f"SELECT event_id AS id, epoch_us(ts) // 1000 AS time_ms, user_id AS user, event_type AS type, {HOST} AS src, round(value, 2) AS value FROM events WHERE event_id % 4 <> 3")
def kv_parser(spark, sf_dir):
    """The same by the parser alone, with quoted values and another order; a pair that is there twice is refused."""
    k = F.col("event_id") % 4
    odd = F.concat(F.lit("type="), F.col("event_type"), F.lit(' user="'), s("user_id"), F.lit('" value='), F.format_string("%.2f", "value"), F.lit("  src="), host(), F.lit(" id="), s("event_id"), F.lit(" time="), ms().cast("string"))
    twice = F.concat(kv_line(), F.lit(" id=1"))
    lines = table(spark, sf_dir, "events").select(F.when(k == 0, odd).when(k == 3, twice).otherwise(kv_line()).alias("payload"))
    p = parser.parse(lines, KV_SPEC).where("parsed.status = 'ok'")
    return p.select(value("id", "v_long").alias("id"), value("time", "v_long").alias("time_ms"), value("user", "v_long").alias("user"), text("type").alias("type"), value("src", "v_string").alias("src"), value("value", "v_double").alias("value"))


@query(f"SELECT event_id AS id, epoch_us(ts) // 1000 AS time_ms, user_id AS user, event_type AS type, {HOST} AS src, round(value, 2) AS value FROM events WHERE event_id % 4 <> 3")
def kv_mixed(spark, sf_dir):
    """The lines of kv_parser, where only some fit the fast path: the values are the same."""
    k = F.col("event_id") % 4
    odd = F.concat(F.lit("type="), F.col("event_type"), F.lit(' user="'), s("user_id"), F.lit('" value='), F.format_string("%.2f", "value"), F.lit("  src="), host(), F.lit(" id="), s("event_id"), F.lit(" time="), ms().cast("string"))
    lines = table(spark, sf_dir, "events").select(F.when(k == 0, odd).when(k == 3, F.concat(kv_line(), F.lit(" id=1"))).otherwise(kv_line()).alias("payload"))
    return fastpath.values(lines, KV_SPEC, {"id": "id", "time_ms": "time", "user": "user", "type": "type", "src": "src", "value": "value"}).where("id IS NOT NULL")


CSV_SPEC = {"id": "csv", "parse": {"op": "csv", "fields": [{"field": "key"} | INT, {"field": "name"}, {"field": "brand"}, {"field": "size"} | INT, {"field": "price", "class": "float", "coerce": {"to": "float"}}]}}


@query("""SELECT p_partkey AS key, concat(p_name, ' "q", ', p_brand) AS name, p_brand AS brand, CAST(p_size AS BIGINT) AS size, p_retailprice AS price FROM part""")
def csv_roundtrip(spark, sf_dir):
    quoted = F.concat(F.lit('"'), F.replace(F.concat("p_name", F.lit(' "q", '), "p_brand"), F.lit('"'), F.lit('""')), F.lit('"'))
    lines = spread(table(spark, sf_dir, "part")).select(F.concat_ws(",", s("p_partkey"), quoted, "p_brand", s("p_size"), s("p_retailprice")).alias("payload"))
    return fastpath.values(lines, CSV_SPEC, {c: c for c in ("key", "name", "brand", "size", "price")})


@query("""SELECT p_partkey AS key, concat(p_name, ' "q", ', p_brand) AS name, p_brand AS brand, CAST(p_size AS BIGINT) AS size, p_retailprice AS price FROM part""")
def csv_parser(spark, sf_dir):
    """The same by the parser alone."""
    quoted = F.concat(F.lit('"'), F.replace(F.concat("p_name", F.lit(' "q", '), "p_brand"), F.lit('"'), F.lit('""')), F.lit('"'))
    lines = spread(table(spark, sf_dir, "part")).select(F.concat_ws(",", s("p_partkey"), quoted, "p_brand", s("p_size"), s("p_retailprice")).alias("payload"))
    p = parser.parse(lines, CSV_SPEC)
    # A quoted cell's span has its quotes; its text is what they hold.
    return p.select(value("key", "v_long").alias("key"), text("name").alias("name"), text("brand").alias("brand"), value("size", "v_long").alias("size"), value("price", "v_double").alias("price"))


POSITIONAL_SPEC = {"id": "positional", "parse": {"op": "positional", "slots": [{"field": "order"} | INT, {"parse": [{"op": "regex", "pattern": "(?P<flag>[A-Z])/(?P<status>[A-Z])", "captures": {"flag": {}, "status": {}}}]}, {"field": "quantity", "class": "float", "coerce": {"to": "float"}}], "tail": {"field": "rest"}}}


@query("SELECT l_orderkey AS \"order\", l_linenumber AS line, l_returnflag AS flag, l_linestatus AS status, l_quantity AS quantity, concat('line ', l_linenumber, '  end') AS rest FROM lineitem")
def positional_roundtrip(spark, sf_dir):
    l = spread(table(spark, sf_dir, "lineitem"))
    lines = l.select("l_linenumber", F.concat(s("l_orderkey"), F.lit("  "), F.concat_ws("/", "l_returnflag", "l_linestatus"), F.lit("\t"), s("l_quantity"), F.lit(" line "), s("l_linenumber"), F.lit("  end")).alias("payload"))
    return fastpath.values(lines, POSITIONAL_SPEC, {c: c for c in ("order", "flag", "status", "quantity", "rest")}, keep=("l_linenumber",)).withColumnRenamed("l_linenumber", "line")


@query("SELECT o_orderkey AS \"order\", substr(o_orderstatus, 1, 1) AS flag, 'Z' AS status, o_totalprice AS quantity, concat('by ', o_orderpriority) AS rest FROM orders")
def positional_parser(spark, sf_dir):
    """The same specification by the parser alone, over other lines."""
    lines = table(spark, sf_dir, "orders").select(F.concat(s("o_orderkey"), F.lit(" "), F.concat_ws("/", F.substring("o_orderstatus", 1, 1), F.lit("Z")), F.lit("  "), s("o_totalprice"), F.lit(" by "), "o_orderpriority").alias("payload"))
    p = parser.parse(lines, POSITIONAL_SPEC)
    return p.select(value("order", "v_long").alias("order"), text("flag").alias("flag"), text("status").alias("status"), value("quantity", "v_double").alias("quantity"), text("rest").alias("rest"))


JSON_SPEC = {"id": "json", "parse": {"op": "json", "keys": {"id": INT, "user.id": INT, "props.k": INT, "tags": {}, "note": {}}}}


def json_line() -> Column:
    return F.concat(F.lit('{"id": '), s("event_id"), F.lit(', "user": {"id":'), s("user_id"), F.lit('}, "props": '), F.col("props"), F.lit(', "tags": ["a", "'), F.col("event_type"), F.lit('"], "note":"tab\\t\\u00e9 \\"x\\"", "more": null}'))


@query("""SELECT event_id AS id, user_id AS user, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, concat('["a", "', event_type, '"]') AS tags, concat('tab', chr(9), 'é "x"') AS note FROM events""")
def json_roundtrip(spark, sf_dir):
    p = parser.parse(spread(table(spark, sf_dir, "events")).select(json_line().alias("payload")), JSON_SPEC)
    return p.select(value("id", "v_long").alias("id"), value("user.id", "v_long").alias("user"), value("props.k", "v_long").alias("k"), text("tags").alias("tags"), text("note").alias("note"))


XML_SPEC = {"id": "xml", "parse": {"op": "xml", "paths": {"s@id": INT, "s/name": {}, "s/nation@code": INT, "s/note": {}}}}


@query("SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS BIGINT) AS nation, 'a <b> &amp;' AS note FROM supplier")
def xml_roundtrip(spark, sf_dir):
    line = F.concat(F.lit('<?xml version="1.0"?><s id="'), s("s_suppkey"), F.lit('"><name> '), F.col("s_name"), F.lit(" </name><nation code='"), s("s_nationkey"), F.lit("'/><note><![CDATA[a <b> &amp;]]></note><!-- x --></s>"))
    p = parser.parse(table(spark, sf_dir, "supplier").select(line.alias("payload")), XML_SPEC)
    return p.select(value("s.id", "v_long").alias("id"), text("s.name").alias("name"), value("s.nation.code", "v_long").alias("nation"), text("s.note").alias("note"))


REGEX_SPEC = {"id": "regex", "parse": [{"op": "regex", "pattern": r"(?P<scheme>[a-z]+)://(?P<host>[^/?#]*)(?P<path>[^?#]*)", "captures": {"scheme": {"class": "word"}, "host": {}, "path": {}}}, {"op": "optional", "step": {"op": "regex", "pattern": r"\?(?P<query>[^#]*)", "captures": {"query": {}}}}, {"op": "optional", "step": {"op": "regex", "pattern": "#(?P<fragment>.*)", "captures": {"fragment": {}}}}]}


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '://([^/?#]*)', 1) AS host, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS query FROM pages".replace("\\\\", "\\"))
def regex_extract(spark, sf_dir):
    p = parser.parse(table(spark, sf_dir, "pages").select("page_id", "url"), REGEX_SPEC, payload="url")
    return p.select("page_id", text("scheme").alias("scheme"), text("host").alias("host"), text("query").alias("query"))


@query("SELECT event_id, 'ok' AS status, length(concat('id=', event_id, ' time=', epoch_us(ts) // 1000, ' user=', user_id, ' type=', event_type, ' src=', " + HOST + ", ' value=', format('{:.2f}', value))) AS bytes, true AS tiled FROM events")
def byte_tiling(spark, sf_dir):
    """Every byte in exactly one span: starts meet ends, and lengths sum up."""
    p = parser.parse(kv_lines(spark, sf_dir), KV_SPEC)
    spans = F.col("parsed.spans")
    meets = F.forall(F.zip_with(spans, F.slice(spans, 2, F.size(spans)), lambda a, b: F.coalesce(b["start"] == a["stop"], F.lit(True))), lambda x: x)
    total = F.aggregate(spans, F.lit(0), lambda n, x: n + x["stop"] - x["start"])
    size = F.octet_length("payload")
    return p.select("event_id", F.col("parsed.status").alias("status"), total.cast("long").alias("bytes"), (meets & (total == size) & (spans[0]["start"] == 0)).alias("tiled"))


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five surfaces in turn, by event id."""
    k = F.col("event_id") % 5
    xml = F.concat(F.lit("<e><id>"), s("event_id"), F.lit("</id></e>"))
    csv = F.concat_ws(",", s("event_id"), "event_type", s("user_id"), F.lit('"a,b"'), *(F.lit(str(n)) for n in range(6)))
    plain = F.concat_ws(" ", s("event_id"), "event_type", host(), F.lit("done"))
    line = F.when(k == 0, kv_line()).when(k == 1, json_line()).when(k == 2, xml).when(k == 3, csv).otherwise(plain)
    return spread(table(spark, sf_dir, "events")).select("event_id", "event_type", "user_id", line.alias("payload"))


@query("SELECT ['kv', 'json', 'xml', 'csv', 'tokens'][event_id % 5 + 1] AS l2, count(*) AS n, sum([6, 0, 0, 10, 4][event_id % 5 + 1]) AS cells FROM events GROUP BY 1")
def surface_detect(spark, sf_dir):
    f = routing.surfaced(mixed_lines(spark, sf_dir))
    return f.groupBy("l2").agg(F.count("*").alias("n"), F.sum(F.coalesce("arity", F.lit(0))).alias("cells"))


def families() -> list[routing.Family]:
    kind = lambda *v: routing.Anchor("type", "key", "type", v)
    word = routing.Anchor("word", "slot", "1", ("click", "view"))
    return [
        routing.Family("kv-errors", "a", surface="kv", anchors=(kind("error", "signup"),)),
        routing.Family("kv-views", "a", surface="kv", anchors=(kind("view"),)),
        routing.Family("json", "b", surface="json"),
        routing.Family("csv-1", "c", surface="csv", arity=(9, 12)),
        routing.Family("csv-2", "c", surface="csv", arity=(10, 10)),
        routing.Family("tokens", "d", surface="tokens", anchors=(word,), classes=("integer", "word", "ipv4", "word")),
    ]


@query("WITH r AS (SELECT CASE event_id % 5 WHEN 0 THEN CASE WHEN event_type IN ('error', 'signup') THEN 'kv-errors' WHEN event_type = 'view' THEN 'kv-views' END WHEN 1 THEN 'json' WHEN 4 THEN CASE WHEN event_type IN ('click', 'view') THEN 'tokens' END END AS family, CASE event_id % 5 WHEN 2 THEN 'routing' WHEN 3 THEN 'routing_ambiguous' END AS other FROM events) SELECT coalesce(family, '-') AS family, CASE WHEN family IS NOT NULL THEN 'routed' ELSE coalesce(other, 'routing_drift') END AS stage, count(*) AS n FROM r GROUP BY 1, 2")
def routing_outcomes(spark, sf_dir):
    r = routing.route(routing.surfaced(mixed_lines(spark, sf_dir)), families())
    return r.groupBy(F.coalesce("family", F.lit("-")).alias("family"), "stage").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, 1704067200000 + event_id AS received, concat('<134>1 2024-01-01T00:09:58Z h', user_id) AS head, CASE WHEN event_id % 3 = 0 THEN 'rfc5424,rfc3164' WHEN event_id % 3 = 1 THEN 'rfc3164,cef' ELSE 'leef' END AS kinds, CASE WHEN event_id % 3 = 0 THEN event_id END AS sequence, CASE WHEN event_id % 3 < 2 THEN concat('d', user_id) END AS hostname, concat('id=', event_id, ' src=', {HOST}) AS payload FROM events")
def envelope_chain(spark, sf_dir):
    """Relayed lines unwrapped to their payload, at most two syslog levels and a CEF or LEEF header."""
    e = spread(table(spark, sf_dir, "events"))
    body = F.concat(F.lit("id="), s("event_id"), F.lit(" src="), host())
    k = F.col("event_id") % 3
    inner = F.concat(F.lit("<13>Jan  1 00:09:58 d"), s("user_id"), F.lit(" "))
    relayed = F.concat(F.lit("<134>1 2024-01-01T00:09:58Z h"), s("user_id"), F.lit(' app - - [meta sequenceId="'), s("event_id"), F.lit('"] '), inner, F.lit("app[13]: "), body)
    line = F.when(k == 0, relayed).when(k == 1, F.concat(inner, F.lit("CEF:0|V\\|x|P|1|100|Name|5|"), body)).otherwise(F.concat(F.lit("LEEF:2.0|V|P|1|E|x09|"), body))
    u = envelopes.unwrap(e.select("event_id", "user_id", line.alias("raw")))
    kinds = F.array_join(F.transform("chain.envelopes", lambda x: x["kind"]), ",")
    named = F.get(F.filter(F.reverse("chain.envelopes"), lambda x: x["kind"] == "rfc3164"), 0)["hostname"]
    return u.select("event_id", (1704067200000 + F.col("event_id")).alias("received"), F.concat(F.lit("<134>1 2024-01-01T00:09:58Z h"), s("user_id")).alias("head"), kinds.alias("kinds"), envelopes.sequence_id().alias("sequence"), named.alias("hostname"), F.col("payload").cast("string").alias("payload"))


MAPPINGS = [
    normalize.Mapping("time", "time", transform="epoch_ms"),
    normalize.Mapping("src_endpoint.ip", "src"),
    normalize.Mapping("activity_id", constant=6),
    normalize.Mapping("severity_id", "type", transform="lookup", table=(("error", "4"), ("view", "1")), default="2"),
    normalize.Mapping("disposition", "type", transform="lookup", table=(("error", "Blocked"),)),
    normalize.Mapping("actor.user.uid", "user", transform="int"),
    normalize.Mapping("duration", "duration", transform="int"),
]


def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that fit are never parsed: their values are read by native expressions; the rest goes through the parser."""
    options = {"activity": "activity_id", "metadata": {"product": "siltline"}, "lineage": ("event_id",)}
    fast, slow = fastpath.mapped(kv_lines(spark, sf_dir), KV_SPEC)
    made = [normalize.normalize(fast, MAPPINGS, 4001, values="_values", **options), normalize.normalize(parser.parse(slow, KV_SPEC), MAPPINGS, 4001, **options)]
    return made[0].select("event_id", "event", "absent", "unmapped").unionByName(made[1].select("event_id", "event", "absent", "unmapped"))


@query(f"SELECT event_id, epoch_us(ts) // 1000 AS time_ms, {HOST} AS ip, 400106 AS type_uid, 4 AS category_uid, CASE event_type WHEN 'error' THEN '4' WHEN 'view' THEN '1' ELSE '2' END AS severity_id, CASE event_type WHEN 'error' THEN 'Blocked' END AS disposition, user_id AS uid, CASE WHEN event_type = 'error' THEN 'duration:structural' ELSE 'disposition:transform_failed,duration:structural' END AS absent, event_id AS unmapped_id FROM events")
def normalized_events(spark, sf_dir):
    """Parsed values in the nested event schema, with the cause of each absence and what wasn't mapped."""
    n = normalized(spark, sf_dir)
    absent = F.array_join(F.transform("absent", lambda a: F.concat(a["attribute"], F.lit(":"), a["cause"])), ",")
    e = "event."
    return n.select("event_id", F.col(e + "time").alias("time_ms"), F.col(e + "src_endpoint.ip").alias("ip"), F.col(e + "type_uid").alias("type_uid"), F.col(e + "category_uid").alias("category_uid"), F.col(e + "severity_id").alias("severity_id"), F.col(e + "disposition").alias("disposition"), F.col(e + "actor.user.uid").alias("uid"), absent.alias("absent"), F.element_at("unmapped", "id").cast("long").alias("unmapped_id"))


@query(f"SELECT * FROM (SELECT strftime(ts, '%Y%m%d') AS event_day, {HOST} AS source, count(*) AS n, row_number() OVER (PARTITION BY strftime(ts, '%Y%m%d') ORDER BY count(*) DESC, {HOST}) AS place FROM events WHERE event_type = 'error' GROUP BY 1, 2) WHERE place <= 10")
def denied_per_source_day(spark, sf_dir):
    """The flagship: device lines parsed and normalised, denied events by source and day, the ten largest of each day."""
    from pyspark.sql import Window

    n = normalized(spark, sf_dir).where("event.disposition = 'Blocked'")
    c = n.groupBy(C.event_day("event.time").alias("event_day"), F.col("event.src_endpoint.ip").alias("source")).agg(F.count("*").alias("n"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("event_day").orderBy(F.desc("n"), "source")).cast("long")).where("place <= 10")


@query("SELECT conv_id, turn, text, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines FROM (SELECT conv_id, turn, concat(role, ': ', text) AS text FROM conversations WHERE text IS NOT NULL)")
def multiline_join(spark, sf_dir):
    """Turns as lines, joined again at the lines that start one."""
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    lines = c.select("conv_id", "turn", F.posexplode(F.split(F.concat_ws(": ", "role", "text"), "\n")).alias("n", "raw")).withColumn("order", F.col("turn") * 1_000_000 + F.col("n"))
    j = frames.multiline(lines, "^(user|assistant|system): ", ["conv_id"], "order")
    return j.select("conv_id", F.floor(F.col("first") / 1_000_000).cast("long").alias("turn"), "text", "n_lines")


@query("SELECT user_id // 10 AS peer, count(*) AS n, true AS whole FROM events GROUP BY 1")
def reconstruct(spark, sf_dir):
    """JSON batches exploded to frames with their own bytes, and put together again byte for byte."""
    e = table(spark, sf_dir, "events").withColumn("peer", F.floor(F.col("user_id") / 10).cast("long"))
    # A batch is a device's message: at most 200 events, so a busy peer sends several.
    e = e.withColumn("batch", F.floor(F.col("event_id") / 200))
    b = e.groupBy("peer", "batch").agg(F.concat(F.lit("[ "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "props"))), lambda x: x["props"]), " ,\n"), F.lit("]\n")).cast("binary").alias("content"), F.count("*").alias("n"))
    f = frames.frames(b.withColumn("sent", F.sha2("content", 256)), "debatch")
    back = frames.reconstructed(f, ["peer", "batch", "n", "sent"])
    good = (F.sha2("content", 256) == F.col("sent"))
    return back.groupBy("peer").agg(F.sum("n").alias("n"), F.bool_and(good).alias("whole"))


@query("SELECT page_id, length(html) - length(replace(html, '<li>', '')) AS removed FROM pages")
def newline_frames(spark, sf_dir):
    """Bytes framed by lines and put together again; what is counted survives."""
    p = table(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("<li>"), F.lit("<li>\r\n")).cast("binary").alias("content"))
    f = frames.frames(p, "newline")
    kept = frames.reconstructed(f, ["page_id"]).select("page_id", F.col("content").cast("string").alias("t"))
    marks = F.length("t") - F.length(F.replace("t", F.lit("<li>\r\n"), F.lit("")))
    return kept.select("page_id", (marks - marks / 3).cast("long").alias("removed"))


def level(x: str) -> str:
    """SQL: the nodes over a list of hex hashes; an odd one goes up as it is."""
    return f"list_transform(range(1, len({x}) + 1, 2), lambda i: CASE WHEN i < len({x}) THEN sha256(unhex('01' || {x}[i] || {x}[i + 1])) ELSE {x}[i] END)"


LEAVES = "WITH r AS (SELECT event_id // 13 AS segment, event_id AS o, concat_ws('|', event_id, event_type, props) AS raw FROM events), l AS (SELECT segment, o, sha256(unhex('00' || hex('siltline-leaf-v1') || hex(CAST(segment AS VARCHAR)) || printf('%016x', o) || printf('%08x', length(raw)) || sha256(raw))) AS leaf FROM r)"
ROOTS = f"{LEAVES}, t0 AS (SELECT segment, list(leaf ORDER BY o) AS x, count(*) AS n FROM l GROUP BY 1), " + ", ".join(f"t{k + 1} AS (SELECT segment, n, {level('x')} AS x FROM t{k})" for k in range(4))


def segment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    raw = F.concat_ws("|", s("event_id"), "event_type", "props")
    return e.select(F.floor(F.col("event_id") / 13).cast("long").alias("segment"), F.col("event_id").alias("offset"), F.length(raw).alias("length"), C.evidence_hash(raw).alias("raw_hash"))


@query(f"{LEAVES} SELECT segment, o AS place, leaf FROM l")
def merkle_leaves(spark, sf_dir):
    """Every record's leaf."""
    return provenance.leaves(segment_records(spark, sf_dir)).select("segment", F.col("offset").alias("place"), "leaf")


@query(f"{ROOTS} SELECT segment, n, x[1] AS root FROM t4")
def merkle_roots(spark, sf_dir):
    """The root of each segment's tree over its records, in order."""
    return provenance.roots(segment_records(spark, sf_dir))


@query(f"{ROOTS.replace('WITH', 'WITH RECURSIVE', 1)}, m0 AS (SELECT segment // 3 AS minute, list(x[1] ORDER BY segment) AS x, count(*) AS n FROM t4 GROUP BY 1), m1 AS (SELECT minute, n, {level('x')} AS x FROM m0), m2 AS (SELECT minute, n, ({level('x')})[1] AS root FROM m1), m AS (SELECT *, row_number() OVER (ORDER BY minute) AS k FROM m2), c AS (SELECT k, minute, n, root, repeat('0', 64) AS prev, sha256(concat_ws('|', 'siltline-checkpoint-v1', minute, n, root, repeat('0', 64))) AS hash FROM m WHERE k = 1 UNION ALL SELECT m.k, m.minute, m.n, m.root, c.hash, sha256(concat_ws('|', 'siltline-checkpoint-v1', m.minute, m.n, m.root, c.hash)) FROM c JOIN m ON m.k = c.k + 1) SELECT minute, n AS n_segments, root, prev, hash FROM c")
def checkpoint_chain(spark, sf_dir):
    """Checkpoints over segments' roots, each with the hash of the whole one before."""
    return provenance.checkpoints(merkle_roots(spark, sf_dir).withColumn("minute", F.floor(F.col("segment") / 3).cast("long")))


@query("SELECT user_id AS peer, count(*) AS n, count(*) // 50 + CASE WHEN count(*) % 50 > 0 THEN 1 ELSE 0 END AS segments FROM events GROUP BY 1")
def segment_rotation(spark, sf_dir):
    """Records assigned to segments that rotate by number of events and of bytes, in arrival order by peer."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("peer"), F.col("event_id").alias("sequence"), F.lit(100).cast("long").alias("bytes"), F.lit(0).cast("long").alias("at"))
    return provenance.segments(e, most_events=50).groupBy("peer").agg(F.count("*").alias("n"), F.count_distinct("segment").alias("segments"))


@query("SELECT p_partkey AS key, 'accepted' AS outcome FROM part WHERE p_size % 10 <> 0 UNION ALL SELECT p_partkey, 'rejected: time is not an integer' FROM part WHERE p_size % 10 = 0")
def lake_refusals(spark, sf_dir):
    """Rows whose time isn't an integer are refused with a reason, not coerced."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 10 == 0, "12.5x").otherwise(s("p_size")).alias("time"))
    return p.select("key", F.when(C.to_int("time").isNull(), "rejected: time is not an integer").otherwise("accepted").alias("outcome"))
