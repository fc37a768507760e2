"""Normalisation, the lake, streaming, sinks and onboarding, end to end on small fixtures."""

import json
import os
import socket
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from siltline.functions import columns as C
from siltline.operators import normalize, parser, routing
from siltline.plans import analytics, onboarding
from siltline.sources import frames, lake, sinks
from siltline.streaming import continuity, pipeline

SPEC = {"id": "kv", "parse": {"op": "kv", "keys": {"date": {"null": ["-"]}, "time": {}, "tz": {}, "t": {"class": "integer", "coerce": {"to": "int", "on_failure": "opaque"}}, "src": {"class": "ip"}, "act": {"class": "word"}}}}
MAP = [
    normalize.Mapping("time", transform="compose_datetime", parts=("date", "time", "tz")),
    normalize.Mapping("src_endpoint.ip", "src"),
    normalize.Mapping("duration", "t", transform="int"),
    normalize.Mapping("action", "act", transform="lookup", table=(("deny", "Denied"),)),
    normalize.Mapping("activity_id", constant=6),
    normalize.Mapping("device.hostname", envelope="hostname"),
]


def test_normalize(spark):
    lines = ["date=2024-01-01 time=01:00:00 tz=+0100 t=5 src=::1 act=deny extra=1", "date=- time=x src=10.0.0.1 act=allow", "t=99999999999999999999 src=1.1.1.1"]
    empty = F.struct(F.array().cast("array<struct<kind:string,hostname:string>>").alias("envelopes")).alias("chain")
    df = spark.createDataFrame([(n, x) for n, x in enumerate(lines)], "event_id int, payload string").select("*", empty)
    out = {r.event_id: r for r in normalize.normalize(parser.parse(df, SPEC), MAP, 4001, activity="activity_id", metadata={"product": "x"}, lineage=("event_id",)).collect()}
    e = out[0].event
    assert e.time == 1704067200000 and e.src_endpoint.ip == "::1" and e.duration == 5 and e.action == "Denied" and e.type_uid == 400106 and e.category_uid == 4 and e.metadata.product == "x" and e.lineage.event_id == 0
    absent = [{a.attribute: a.cause for a in out[n].absent} for n in range(3)]
    assert absent[0] == {"device.hostname": "structural"}
    assert absent[1] == {"time": "transform_failed", "duration": "structural", "action": "transform_failed", "device.hostname": "structural"}
    assert absent[2]["duration"] == "uncoercible"


def test_lake_versions(spark, tmp_path):
    path = str(tmp_path / "lake")
    raw = spark.createDataFrame([(n, f"v={n}".encode()) for n in range(10)], "event_id long, raw binary").withColumn("raw_hash", C.evidence_hash("raw"))

    def derive(scale):
        return lambda df: df.where("event_id < 9").select("event_id", (F.substring(F.col("raw").cast("string"), 3, 9).cast("int") * F.when(F.col("event_id") >= 5, scale).otherwise(1)).alias("value"))

    first = derive(1)(raw).unionByName(spark.createDataFrame([(9, 9)], "event_id long, value int"))
    lake.write_version(first, path, 1)
    with pytest.raises(Exception, match="(?i)exist"):
        lake.write_version(first, path, 1)
    assert lake.verify(spark, path, first.schema).collect() == []
    files = sorted(os.listdir(lake.version_path(path, 1)))
    assert lake.renormalize(spark, path, first.schema, raw, derive(1)) == {"corrected": 0, "unchanged": 9, "not_applicable": 1}
    assert lake.renormalize(spark, path, first.schema, raw, derive(10)) == {"corrected": 4, "unchanged": 5, "not_applicable": 1}
    assert sorted(os.listdir(lake.version_path(path, 1))) == files
    now = {r.event_id: (r.normalization_version, r.value) for r in lake.latest(lake.read_versions(spark, path)).collect()}
    assert now[4] == (1, 4) and now[5] == (2, 50) and now[9] == (1, 9) and len(now) == 10
    m = {r.version: r for r in lake.manifest(spark, path).collect()}
    assert m[2].derived_from == 1 and m[2].n == 4
    with pytest.raises(ValueError, match="evidence"):
        lake.renormalize(spark, path, first.schema, raw.where("event_id > 0"), derive(1))
    with pytest.raises(ValueError, match="evidence"):
        lake.renormalize(spark, path, first.schema, raw.withColumn("raw", F.lit(b"x")), derive(1))
    spark.createDataFrame([(77, 1)], "event_id long, value int").write.mode("append").parquet(lake.version_path(path, 2))
    assert [tuple(r) for r in lake.verify(spark, path, first.schema).collect()] == [(2, "count")]
    with pytest.raises(ValueError, match="manifest"):
        lake.renormalize(spark, path, first.schema, raw, derive(1))


def test_lake_batches(spark, tmp_path):
    path = str(tmp_path / "events")
    events = lake.with_partitions(spark.createDataFrame([(n, 1704067200000 + n * 43_200_000) for n in range(4)], "event_id long, time long"))
    lake.write_events(events.where("event_id < 2"), path, batch=0)
    lake.write_events(events.where("event_id >= 2"), path, batch=1)
    lake.write_events(events.where("event_id >= 2"), path, batch=1)  # redelivered
    got = spark.read.parquet(path)
    assert got.count() == 4 and {str(r.event_day) for r in got.select("event_day").distinct().collect()} == {"20240101", "20240102"}
    diff = analytics.paths_that_differ(events.select("event_id", "time"), events.where("event_id > 0").select("event_id", (F.col("time") + (F.col("event_id") == 1).cast("int")).alias("time")), "event_id", ["time"])
    assert {(r.event_id, r.path) for r in diff.collect()} == {(0, "time"), (1, "time")}


def pack():
    family = routing.Family("kv", "p", envelope="any", surface="kv")
    return pipeline.Pack([family], {"kv": {"parse": {"op": "kv", "keys": {"id": {"class": "integer"}, "time": {"class": "integer"}, "src": {"class": "ipv4"}}}}}, {"kv": [normalize.Mapping("time", "time", transform="epoch_ms"), normalize.Mapping("src_endpoint.ip", "src")]})


def test_stream(spark, tmp_path):
    drop, out = tmp_path / "in", str(tmp_path / "out")
    drop.mkdir()
    line = "<13>Jan  1 00:00:00 h app: id={0} time=1704067200 src=10.0.0.{0}\n"
    (drop / "a.log").write_text("".join(line.format(n) for n in range(5)) + "not for anyone\n" + "<13>Jan  1 00:00:00 h app: id=x time=1 src=1.1.1.1\n")
    (drop / ".hidden").write_text("x\n")
    (drop / "old.log.done").write_text("x\n")
    run = lambda: pipeline.run(frames.files(spark, str(drop), stream=True), out, pack).awaitTermination(120)
    run()
    (drop / "b.log").write_text(line.format(9) + "x" * 70_000 + "\n")
    run()
    run()  # nothing new
    evidence, events, refused = (spark.read.parquet(f"{out}/{t}") for t in ("evidence", "events", "quarantine"))
    assert evidence.count() == 10 and events.count() == 6
    assert {r.event_id for r in events.collect()} <= {r.event_id for r in evidence.collect()}
    assert sorted((r.stage, r.reason[:9]) for r in refused.collect()) == [("framing", "continuat"), ("framing", "truncated"), ("parse", "id: not i"), ("routing", refused.where("stage = 'routing'").first().reason[:9])]
    assert evidence.where(C.evidence_hash("raw") != F.col("raw_hash")).count() == 0
    # A replayed batch writes the same again.
    before = sorted(r.event_id for r in events.collect())
    pipeline.batch_writer(out, pack)(frames.files(spark, str(drop / "b.log")), 1)
    assert sorted(r.event_id for r in spark.read.parquet(f"{out}/events").collect()) == before
    evidence = spark.read.parquet(f"{out}/evidence")
    whole = frames.reconstructed(evidence.withColumn("frame_index", F.monotonically_increasing_id()).where("peer LIKE '%b.log'"), ["peer"]).first().content
    assert len(whole) == len((drop / "b.log").read_bytes())


def test_continuity():
    p = continuity.Peer("a")
    out = [r for n, (seq, at) in enumerate([(None, 0), (5, 10), (6, 20), (None, 25), (9, 30), (2, 40), (3, 50)]) for r in p.see(f"e{n}", seq, at)]
    assert [(r["kind"], r["expected"], r["observed"], r["missing"], r["last_event_id"]) for r in out] == [("sequence_gap", 7, 9, 2, "e3"), ("sequence_reset", 10, 2, None, "e4")]
    assert p.sweep(99, 50) == [] and p.sweep(100, 50)[0]["kind"] == "silence" and p.sweep(200, 50) == []
    assert [(r["kind"], r["silence_ms"]) for r in p.see("e9", 4, 250)] == [("silence_end", 200)] and p.lost(260)[0]["kind"] == "connection_lost"


def test_continuity_stream(spark, tmp_path):
    path = str(tmp_path / "frames")
    schema = "peer string, event_id string, sequence long, received_ms long, lost boolean"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    put([("a", "1", 1, 10, False), ("a", "2", 4, 20, False), ("b", "3", None, 30, False)])
    stream = spark.readStream.schema(schema).parquet(path)
    q = continuity.track(stream).writeStream.format("memory").queryName("gaps").outputMode("append").start()
    q.processAllAvailable()
    put([("a", "5", 2, 40, False), ("b", "6", None, 50, True)])
    q.processAllAvailable()
    q.stop()
    got = sorted((r.peer, r.kind, r.expected, r.observed) for r in spark.sql("SELECT * FROM gaps").collect())
    assert got == [("a", "sequence_gap", 2, 4), ("a", "sequence_reset", 5, 2), ("b", "connection_lost", None, None)]


class Receiver(BaseHTTPRequestHandler):
    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"])).decode()
        s = self.server
        s.requests += 1
        if s.requests == 1:
            self.send_response(503)
            self.end_headers()
            return
        if self.path == "/bulk":
            docs = body.strip().split("\n")[::2]
            if len(docs) > 3:
                self.send_response(413)
                self.end_headers()
                return
            items = []
            for d in docs:
                id = json.loads(d)["index"]["_id"]
                status = 400 if id == "7" else 429 if id == "3" and id not in s.tried else 200
                s.tried.add(id)
                if status == 200:
                    s.seen.append(id)
                items.append({"index": {"status": status, "error": "bad" if status == 400 else None}})
            answer = json.dumps({"items": items}).encode()
        else:
            s.seen += body.strip().split("\n")
            answer = b""
        self.send_response(200)
        self.end_headers()
        self.wfile.write(answer)

    def log_message(self, *args):
        pass


@pytest.fixture
def receiver():
    server = HTTPServer(("127.0.0.1", 0), Receiver)
    server.requests, server.seen, server.tried = 0, [], set()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def test_http_and_bulk(spark, receiver):
    url = f"http://127.0.0.1:{receiver.server_port}"
    df = spark.range(10).select(F.col("id").cast("string").alias("value")).coalesce(1)
    sinks.http(url, most=4)(df, 0)
    assert sorted(receiver.seen, key=int) == [str(n) for n in range(10)]
    receiver.seen.clear()
    docs = spark.range(10).select(C.bulk(F.col("id").cast("string"), F.lit(1), F.lit("{}")).alias("value")).coalesce(1)
    sinks.bulk(f"{url}/bulk", most=10)(docs, 0)
    assert sorted(receiver.seen, key=int) == [str(n) for n in range(10) if n != 7]


def test_syslog_tcp(spark, tmp_path):
    server, got = socket.create_server(("127.0.0.1", 0)), []

    def serve():
        c, _ = server.accept()
        with c:
            while part := c.recv(4096):
                got.append(part)

    t = threading.Thread(target=serve, daemon=True)
    t.start()
    df = spark.createDataFrame([("one",), ("zwölf",)], "value string").coalesce(1)
    sinks.syslog_tcp("127.0.0.1", server.getsockname()[1])(df, 0)
    t.join(10)
    assert [f["raw"].decode() for f in frames.octet(b"".join(got))] == ["one", "zwölf"]
    sinks.ndjson(df, str(tmp_path / "out"))
    assert {json.loads(r.value)["value"] for r in spark.read.text(str(tmp_path / "out")).collect()} == {"one", "zwölf"}


def test_onboarding(spark):
    lines = spark.createDataFrame([(f"{n} {n / 4:.2f} fw 10.0.0.{n} {'a/b' if n % 2 else 'c'}",) for n in range(40)] + [("odd one",)], "raw string")
    got = {r.slot: r for r in onboarding.slots(lines).collect()}
    assert [got[k]["class"] for k in range(5)] == ["integer", "float", "word", "ipv4", "text"] and got[2].constant and got[0].n_distinct == 40 and len(got[0].samples) == 8
    spec = onboarding.induce(lines)
    good = lines.where("raw != 'odd one'")
    v = onboarding.acceptance(good, good.limit(5), spec)
    assert v.accepted and v.parsed == 1.0 and v.byte_coverage == 1.0
    assert not onboarding.acceptance(lines, good, spec).accepted
    kv = spark.createDataFrame([("a=1 b=2 c=3",), ("a=1 b=2 d=4",)], "raw string")
    assert sorted(onboarding.draft(kv)["parse"]["keys"]) == ["a", "b", "c", "d"] and sorted(onboarding.draft(kv, share=0.6)["parse"]["keys"]) == ["a", "b"]
    js = spark.createDataFrame([('{"x":1,"y":{"z":"q"}}',)], "raw string")
    assert sorted(onboarding.draft(js)["parse"]["keys"]) == ["x", "y.z"]
    assert len(onboarding.draft(spark.createDataFrame([(",".join("abcdefghij"),)], "raw string"))["parse"]["fields"]) == 10
    values = spark.createDataFrame([("n", "f1", "x"), ("n", "f2", "y"), ("m", "f1", "x"), ("m", "f2", "x")], "anchor string, family string, value string")
    assert {r.anchor: r.admitted for r in onboarding.admitted_anchors(values).collect()} == {"n": True, "m": False}
    fields = spark.createDataFrame([("p", "integer", ["1", "2"], "k1"), ("q", "word", ["a"], "k2")], "field string, class string, samples array<string>, slot_key string")
    attributes = spark.createDataFrame([("port", ["integer"], None), ("flag", ["integer"], ["0", "1"]), ("name", ["word", "text"], None)], "attribute string, accepts array<string>, domain array<string>")
    assert {tuple(r) for r in onboarding.candidates(fields, attributes).collect()} == {("p", "port"), ("q", "name")}
    store = spark.createDataFrame([("k1", "port")], "slot_key string, attribute string")
    assert {(r.field, r.origin) for r in onboarding.propagated(fields, store).collect()} == {("p", "propagated"), ("q", "open")}


def test_multiline(spark):
    lines = [(1, 0, "  tail of before"), (1, 1, "START a"), (1, 2, "  more"), (1, 3, "START b")] + [(2, 0, "START x")] + [(2, n, "y") for n in range(1, 6)]
    df = spark.createDataFrame(lines, "peer int, seq int, raw string")
    got = [(r.peer, r.first, r.n_lines, r.confidence) for r in frames.multiline(df, "^START", ["peer"], "seq", most_lines=4).orderBy("peer", "first").collect()]
    assert got == [(1, 0, 1, "low"), (1, 1, 2, "high"), (1, 3, 1, "high"), (2, 0, 4, "low"), (2, 4, 2, "low")]
    raw = [(0, b"S \xff", b"\r\n"), (1, b"two", b"\n"), (2, b"", b"\r\n"), (3, b"S x", b""), (4, b"y" * 30, b"\n"), (5, b"z", b"\n")]
    rows = frames.multiline(spark.createDataFrame([(1, *r) for r in raw], "p int, seq int, raw binary, suffix binary"), "^S", ["p"], "seq", end="suffix", most_bytes=32).orderBy("first").collect()
    assert b"".join(bytes(r.raw + r.suffix) for r in rows) == b"".join(a + b for _, a, b in raw)  # byte for byte
    assert [(r.first, r.n_lines, r.text, r.confidence) for r in rows] == [(0, 3, None, "high"), (3, 2, "S x" + "y" * 30, "high"), (5, 1, "z", "low")]


def test_signatures():
    from siltline.operators import signing

    # The first vector of RFC 8032.
    secret = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert signing.public_key(secret).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    made = signing.sign(secret, b"")
    assert made.hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e06522490155")
    public = signing.public_key(secret)
    assert signing.verify(public, b"", made) and not signing.verify(public, b"x", made) and not signing.verify(public, b"", made[:-1] + b"\0")


def test_packs_fail_closed():
    from siltline.operators import packs, signing

    secret = bytes(range(32))
    trusted = {"k": signing.public_key(secret)}
    good = {"id": "p", "families": [{"id": "f", "surface": "kv", "spec": {"parse": {"op": "kv", "keys": {"a": {}}}}, "anchors": [{"id": "x", "kind": "key", "at": "dev", "values": ["1"]}], "mapping": [{"attribute": "a", "path": "a"}]}]}
    log = packs.Log()
    for other in ({"id": "x"}, good, {"id": "y"}):
        log.append(other)
    loaded = packs.load(packs.signed(good, secret, "k"), trusted, log.root(), log.prove(1))
    assert loaded.families[0].anchors[0].values == ("1",) and loaded.mappings["f"][0].attribute == "a"

    def broken(**change):
        d = json.loads(json.dumps(good))
        d["families"][0] |= change
        return packs.signed(d, secret, "k")

    twice = json.loads(json.dumps(good))
    twice["families"].append(twice["families"][0] | {"id": "g"})
    for bad in (
        packs.signed(good, secret, "other"), packs.signed(good, secret, "k") | {"document": {"id": "p"}}, packs.signed({"id": "p"}, secret, "k"), packs.signed(twice, secret, "k"),
        broken(spec={"parse": {"op": "eval"}}), broken(parser_hash="sha256:0"), broken(anchors=[{"id": "x", "kind": "guess", "at": "", "values": ["1"]}]), broken(mapping=[{"attribute": "a", "transform": "eval"}]), broken(mapping=[{"attribute": "a"}, {"attribute": "a"}]), broken(extra={"confidence": 0.9}),
    ):
        with pytest.raises(packs.Refused):
            packs.load(bad, trusted)
    with pytest.raises(packs.Refused):
        packs.load(packs.signed(good, secret, "k"), trusted, log.root(), log.prove(0))


def test_bundles():
    import hashlib

    from siltline.operators import packs, signing

    secret = b"\x07" * 32
    raws = [f"line {n}".encode() for n in range(6)]
    records = [{"offset": n * 10, "length": len(r), "raw_hash": "sha256:" + hashlib.sha256(r).hexdigest()} for n, r in enumerate(raws)]
    b, trusted = packs.bundle("s1", records, 4, secret, "k"), {"k": signing.public_key(secret)}
    assert packs.verify_bundle(b, trusted, raws[4]) is None
    assert packs.verify_bundle(b, trusted, b"x") == "raw bytes" and packs.verify_bundle(b, {}) == "signature"
    assert packs.verify_bundle(b | {"record": records[3]}, trusted) == "proof" and packs.verify_bundle(b | {"segment": "s2"}, trusted) == "proof"


@pytest.mark.parametrize("protocol", ["tcp", "udp"])
def test_listener(protocol):
    import time

    from siltline.sources import network

    reader = network.Reader({"protocol": protocol, "port": "0", "maxframes": "1000"})
    network._inboxes.clear()
    address = ("127.0.0.1", reader.inbox.port)
    if protocol == "tcp":
        with socket.create_connection(address) as s:
            s.sendall(b"one\r\ntwo\npart")
    else:
        with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
            for x in (b"one", b"two", b"part"):
                s.sendto(x, address)
    for _ in range(100):
        if reader.inbox.next >= 3:
            break
        time.sleep(0.05)
    rows, end = reader.read(reader.initialOffset())
    got = list(rows)
    assert [r[2] for r in got] == [b"one", b"two", b"part"] and got[0][3] == ("newline" if protocol == "tcp" else "udp_datagram")
    assert [r[2] for r in reader.readBetweenOffsets({"next": 1}, end)] == [b"two", b"part"]
    reader.commit(end)
    assert list(reader.read(end)[0]) == [] and not reader.inbox.rows


def test_two_connectors_count_lines_in_pieces_once(spark, tmp_path):
    import duckdb
    from siltline import catalogue

    long = "x" * (3 * frames.MOST_BYTES + 1)
    pages = [(long,), (f"<ul>a<li>{long}<li>b\r<li>",), ("one<li>two",), ("",), (None,), ("ends\r",)]
    spark.createDataFrame(pages, "html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([("n" * (frames.MOST_BYTES + 5),), ("Customer#1",)], "c_name string").write.parquet(str(tmp_path / "customer.parquet"))
    duck = duckdb.connect()
    for t in ("pages", "customer"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    answer = duck.execute(catalogue.ORACLE_SQL["two_connectors"])
    columns = [c[0] for c in answer.description]
    assert sorted(map(tuple, catalogue.QUERIES["two_connectors"](spark, str(tmp_path)).select(*columns).collect())) == sorted(answer.fetchall())
