"""The parser algebra, framing, envelopes, routing: single payloads, then over DataFrames."""

import hashlib
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltline.operators import envelopes, parser, provenance, routing
from siltline.operators.parser import Program, SpecError
from siltline.plans import fastpath
from siltline.sources import frames


def run(parse, data, **more):
    out = Program({"parse": parse} | more).parse(data if isinstance(data, bytes) else data.encode())
    if out["status"] == "ok":
        for b in out["buffers"]:
            at = 0
            for s in (s for s in out["spans"] if s["buffer"] == b["name"]):
                assert s["start"] == at
                at = s["stop"]
            assert at == b["length"]
    return out


def texts(out):
    return {s["path"]: s.get("text") for s in out["spans"] if s["kind"] == "semantic"}


def opaque(out):
    return [s["path"] for s in out["spans"] if s["kind"] == "opaque"]


A, B, N = {"field": "a"}, {"field": "b"}, {"field": "n", "class": "integer", "coerce": {"to": "int"}}


def test_squid_like_line():
    spec = {"op": "positional", "slots": [{"field": "time", "class": "float", "coerce": {"to": "timestamp", "format": {"kind": "epoch_s_frac"}}}, {"field": "duration", "class": "integer", "coerce": {"to": "int"}}, {"field": "client", "class": "ip", "coerce": {"to": "ip"}}, {"parse": [{"op": "regex", "pattern": "(?P<result>[A-Z_]+)/(?P<code>[0-9]{3})", "captures": {"result": {"class": "word"}, "code": {"class": "integer"}}}]}, {"field": "user", "null": ["-"]}]}
    out = run(spec, "1704067200.123   5 10.0.0.1 TCP_MISS/200 -")
    assert texts(out) == {"time": "1704067200.123", "duration": "5", "client": "10.0.0.1", "result": "TCP_MISS", "code": "200", "user": "-"}
    by = {s["path"]: s for s in out["spans"]}
    assert by["time"]["coerced"] == {"to": "timestamp", "value": 1704067200123} and by["user"]["declared_null"]


@pytest.mark.parametrize(
    ("parse", "good", "bad"),
    [
        ([{"op": "literal", "text": "x="}, {"op": "regex", "pattern": "(?P<a>[a-z]+)", "captures": {"a": {}}}], "x=abc", ["x=", "y=a", "x=abc1"]),
        ({"op": "csv", "fields": [A, B]}, '"a ""q"",",b', ["a", 'a"b,"c', '"a"x,b']),
        ({"op": "csv", "fields": [A], "extra_fields": "reject"}, "a", ["a,b", "a,"]),
        ({"op": "kv", "keys": {"a": {}, "b": {}}}, 'a="x y" b=2 c=3', ["a", "a=1 a=2", "=1", 'a="x']),
        ({"op": "kv", "keys": {"a": {}, "b": {}}, "order": "declared", "unknown_keys": "reject"}, "a=1 b=2", ["b=2 a=1", "a=1 c=1"]),
        ({"op": "kv", "keys": {"a": {}}, "pair_separator": ";", "key_value_separator": ":", "allow_bare_keys": True}, "a:1;x", ["a:1;;x"]),
        ({"op": "positional", "delimiter": "|", "slots": [A, N], "leading": "allow", "trailing": "allow"}, "|x|5|", ["x||5", "x|y", "x"]),
        ({"op": "quoted", "open": "<", "close": ">", "escape": "backslash", "content": A}, r"<a\>b>", ["<a", "a>"]),
        ([{"op": "optional", "step": {"op": "literal", "text": "- "}}, {"op": "regex", "pattern": "(?P<n>.+)", "captures": {"n": {"class": "integer"}}}], "- 12", ["- x"]),
        ({"op": "repeated", "separator": ",", "min": 2, "step": {"op": "regex", "pattern": "(?P<a>[0-9]+)", "captures": {"a": {}}}}, "1,2,3", ["1", "1,2,"]),
        ({"op": "json", "keys": {"a.b": {}, "n": {"class": "integer"}}}, '{"a":{"b":"x"},"n":1,"z":[1,{"q":2}]}', ["[]", '{"n":1', '{"n":"x"}', '{"n":1,"n":2}', '{"a":1} x', "{,}"]),
        ({"op": "json", "keys": {"a": {}}, "unknown_keys": "reject"}, '{"a":[1, 2]}', ['{"b":1}']),
        ({"op": "xml", "paths": {"r/a": {}, "r@i": {}}}, '<r i="1"><a> x &lt; </a></r>', ["<r><a>1</a><a>2</a></r>", "<r>", "<r></x>", "<r/><r/>", "x<r/>"]),
    ],
)
def test_steps(parse, good, bad):
    assert run(parse, good)["status"] == "ok"
    for data in bad:
        assert run(parse, data)["status"] == "failed", data


def test_values_of_steps():
    assert texts(run({"op": "csv", "fields": [A, B], "missing_fields": "allow"}, '"a ""q"", x"'))["a"] == 'a "q", x'
    assert opaque(run({"op": "csv", "fields": [A]}, "1,2,,3")) == ["extra.0", "extra.2"]
    assert opaque(run({"op": "kv", "keys": {}}, "q=1 r=")) == ["unknown.q"]
    out = run({"op": "json", "keys": {"s": {}, "n": {}, "l": {}}}, '{"s":"a\\u00e9\\ud83d\\ude00\\n", "n": null, "l": [1, "x"], "deep":{"k.v":1}}')
    assert texts(out) == {"s": "aé😀\n", "n": "null", "l": '[1, "x"]'} and opaque(out) == ["unknown.deep.k_.v"]
    out = run({"op": "xml", "paths": {"r/a": {}, "r/b@x": {}}}, "<?xml version='1.0'?><!-- c --><r><a><![CDATA[<&>]]></a><b x='1'/><z>t</z></r>")
    assert texts(out) == {"r.a": "<&>", "r.b.x": "1"} and opaque(out) == ["unknown.r_z"]
    assert texts(run({"op": "repeated", "separator": " ", "step": {"op": "regex", "pattern": "(?P<a>[a-z])", "captures": {"a": {}}}}, "x y")) == {"[0].a": "x", "[1].a": "y"}


def test_decode_and_failures():
    cell = {"field": "a", "decode": {"encoding": "base64", "then": {"op": "kv", "keys": {"k": {}}}}}
    import base64

    out = run({"op": "positional", "slots": [cell]}, base64.b64encode(b"k=v"))
    assert texts(out)["a.k"] == "v" and [b["name"] for b in out["buffers"]] == ["raw", "a#decoded"]
    soft = {"field": "a", "decode": {"encoding": "hex", "on_failure": "opaque", "then": {"op": "kv", "keys": {}, "unknown_keys": "reject"}}}
    out = run({"op": "positional", "slots": [soft]}, b"k=v".hex())  # decodes, but what it holds is refused: no buffer stays
    assert out["status"] == "ok" and opaque(out) == ["a"] and len(out["buffers"]) == 1
    assert opaque(run({"op": "positional", "slots": [{"field": "n", "coerce": {"to": "int", "on_failure": "opaque"}}]}, "x")) == ["n"]
    assert run({"op": "positional", "slots": [N]}, "99999999999999999999")["status"] == "failed"
    assert opaque(run({"op": "positional", "slots": [A]}, b"\xff\xfe")) == ["a"]
    assert run({"op": "positional", "slots": [A]}, "x" * 11, max_event_bytes=10)["status"] == "failed"


@pytest.mark.parametrize(
    "parse",
    [
        {"op": "eval"}, {"op": "regex", "pattern": r"(?P<a>x)\1", "captures": {"a": {}}}, {"op": "regex", "pattern": r"(?=x)(?P<a>x)", "captures": {"a": {}}}, {"op": "regex", "pattern": "(?P<a>(?P<b>x))", "captures": {"a": {}, "b": {}}},
        {"op": "regex", "pattern": "(?P<a>x)", "captures": {}}, {"op": "regex", "pattern": "(", "captures": {}}, {"op": "csv", "fields": [A, A]}, {"op": "csv", "fields": [{"field": "a", "class": "odd"}]}, {"op": "csv", "fields": [{"field": "a", "opaque": True, "class": "word"}]},
        {"op": "csv", "fields": [{"field": "a", "decode": {"encoding": "rot13"}}]}, {"op": "csv", "fields": [{"field": "a", "coerce": {"to": "enum"}}]}, {"op": "csv", "fields": [{"field": "a", "coerce": {"to": "int", "on_failure": "guess"}}]}, {"op": "repeated", "min": 3, "max": 2, "step": []}, {"op": "literal", "text": ""}, {"op": "quoted"},
    ],
)
def test_specifications_are_checked(parse):
    with pytest.raises(SpecError):
        Program({"parse": parse})


def test_hash_is_of_the_program():
    one, two = ({"op": "kv", "keys": {"a": {}, "b": {}}}, {"keys": {"b": {}, "a": {}}, "op": "kv"})
    assert Program({"id": "x", "parse": one}).parser_hash == Program({"id": "y", "parse": two}).parser_hash
    assert Program({"parse": one}).parser_hash != Program({"parse": [one]}).parser_hash


@given(st.text(st.sampled_from('ab="\\ ,{}[]:1<>/'), max_size=40))
@settings(max_examples=300, deadline=None)
def test_every_parse_tiles_or_fails(text):
    for parse in ({"op": "kv", "keys": {"a": {}}, "allow_bare_keys": True}, {"op": "csv", "fields": [A], "missing_fields": "allow"}, {"op": "json", "keys": {"a": {}}}, {"op": "xml", "paths": {"a": {}}}, {"op": "positional", "slots": [A], "tail": B, "leading": "allow"}):
        run(parse, text)


@given(st.binary(max_size=60).map(lambda b: b.replace(b"\x03", b"\n").replace(b"\x05", b"\r\n")), st.integers(1, 8))
@settings(max_examples=200, deadline=None)
def test_frames_give_their_input_again(data, most):
    for made in (frames.newline(data, most), frames.octet(data, most), iter(frames.debatch(data))):
        parts = list(made)
        assert b"".join(f["framing"]["raw_prefix"] + f["raw"] + f["framing"]["raw_suffix"] for f in parts) == data
        assert all(len(f["raw"]) <= most or f["framing"]["method"] in ("whole", "json_batch") for f in parts)


def test_framing():
    f = list(frames.newline(b"a\r\nbb\nlonger line\nend", 5))
    assert [(x["raw"], x["framing"]["truncation_status"], x["framing"]["confidence"]) for x in f] == [(b"a", "none", "high"), (b"bb", "none", "high"), (b"longe", "truncated", "low"), (b"r lin", "truncated", "low"), (b"e", "continuation", "low"), (b"end", "none", "low")]
    f = list(frames.octet(b"3 abc5 hel\nline\n9 short"))
    assert [(x["raw"], x["framing"]["method"]) for x in f][:2] == [(b"abc", "octet_counted"), (b"hel\nl", "octet_counted")] and f[-1]["framing"]["truncation_status"] == "truncated"
    f = frames.debatch(b' [ {"a":1} ,\n"x",[2] ]\n')
    assert [x["raw"] for x in f] == [b'{"a":1}', b'"x"', b"[2]"] and f[1]["framing"]["batch_index"] == 1 and f[0]["framing"]["batch_size"] == 3
    assert len(frames.debatch(b"[]")) == len(frames.debatch(b"[1,]")) == 1 and frames.debatch(b"[1] x")[0]["raw"] == b"[1] x"
    assert list(frames.datagram(b"abcdef", 4))[0]["framing"]["truncation_status"] == "truncated"


def test_envelopes():
    def kinds(raw):
        c = envelopes.chain(raw)
        return [e["kind"] for e in c["envelopes"]], raw[c["payload_start"] :]

    assert kinds(b'<134>1 2024-01-01T00:00:00Z h app - - [meta sequenceId="7" x="a\\]b"] \xef\xbb\xbfbody') == (["rfc5424"], b"body")
    assert kinds(b"<134>1 - - - - - - body") == (["rfc5424"], b"body") and kinds(b"<192>1 - - - - - - body")[0] == []
    assert kinds(b"<34>Oct 11 22:14:15 host su[12]: msg: x") == (["rfc3164"], b"msg: x")
    assert kinds(b"Oct 11 2023 22:14:15 host plain text") == (["rfc3164"], b"plain text")
    assert kinds(b"<13>only") == (["rfc3164"], b"only") and kinds(b"<013>x")[0] == [] and kinds(b"")[0] == []
    assert kinds(b"<13>Oct  1 22:14:15 h CEF:0|a\\|b|P|1|100|N|5|src=1") == (["rfc3164", "cef"], b"src=1")
    assert kinds(b"CEF:0|a|P|1|100|N|5|")[0] == [] and kinds(b"LEEF:1.0|V|P|1|E|a=1\tb=2") == (["leef"], b"a=1\tb=2")
    assert envelopes.chain(b"LEEF:2.0|V|P|1|E|x7C|a=1")["envelopes"][0]["delimiter"] == "|"
    deep = b"<1>1 - - - - - - " * 3 + b"x"
    assert len(envelopes.chain(deep)["envelopes"]) == 2


def test_over_dataframes(spark):
    rows = [(1, b"<13>Oct 11 22:14:15 h app[3]: a=1 b=x", "c"), (2, b"plain", "d"), (3, None, "e")]
    df = spark.createDataFrame(rows, "id int, raw binary, spans string")
    u = envelopes.unwrap(df)
    got = {r.id: r for r in u.select("id", "payload", envelopes.envelope_value("hostname").alias("h"), envelopes.envelope_value("proc_id").alias("p")).collect()}
    assert bytes(got[1].payload) == b"a=1 b=x" and (got[1].h, got[1].p) == ("h", "3") and bytes(got[3].payload) == b"" and got[2].h is None
    p = parser.parse(u, {"parse": {"op": "kv", "keys": {"a": {"class": "integer", "coerce": {"to": "int"}}}}})
    one = p.where("id = 1").select("spans", "parsed", parser.texts().alias("t")).first()
    assert one.parsed.status == "ok" and one.t == {"a": "1"} and one.spans == "c"
    assert p.where("id = 2").first().parsed.status == "failed" and parser.parse(u.limit(0), {"parse": []}).collect() == []
    with pytest.raises(ValueError):
        parser.parse(p, {"parse": []})
    with pytest.raises(SpecError):
        parser.parse(u, {"parse": {"op": "nope"}})


def test_fast_path_is_the_parser(spark):
    lines = ["a=1 b=x", "b=y a=2 c=3", "a= b=z", "a=-1"]
    spec = {"parse": {"op": "kv", "keys": {"a": {}, "b": {"null": ["z"]}}}}
    df = spark.createDataFrame([(x,) for x in lines], "payload string")
    fast = {r.payload: (r.a, r.b) for r in df.select("payload", *(c.alias(n) for n, c in fastpath.columns(spec, "payload").items())).collect()}
    slow = {r.payload: (r.t.get("a"), r.t.get("b")) for r in parser.parse(df, spec).select("payload", parser.texts().alias("t")).collect()}
    assert fast == slow
    spec = {"parse": {"op": "positional", "slots": [A, B]}}
    df = spark.createDataFrame([("x  y",), ("1\t2",)], "payload string")
    assert [tuple(r) for r in df.select(*fastpath.columns(spec, "payload").values()).collect()] == [("x", "y"), ("1", "2")]
    assert fastpath.columns({"parse": {"op": "csv", "fields": [A]}}, "payload") is None


def test_routing(spark):
    anchor = routing.Anchor("dev", "key", "devname", ("fw1", "fw2"))
    families = [routing.Family("a", "p1", surface="kv", anchors=(anchor,)), routing.Family("b", "p2", surface="tokens", arity=(2, 3)), routing.Family("c", "p3", surface="tokens", classes=("integer", "word")), routing.Family("d", "p3", envelope="cef", surface="kv"), *(routing.Family(f"x{n}", "p4", surface="json") for n in range(5))]
    rows = [("raw", "devname=fw1 x=1 y=2", None), ("raw", "devname=fw9 x=1 y=2", None), ("raw", "x=1 y=2 z=3", None), ("raw", "a b c", None), ("raw", "1 word", None), ("raw", "1 word", ["p3"]), ("cef", "x=1 y=2 z=3", None), ("raw", ' {"a":1}', None), ("raw", "<a/>", None), ("raw", "", None)]
    df = spark.createDataFrame(rows, "l1_ string, payload string, allowed array<string>")
    got = [(r.family, r.stage) for r in routing.route(routing.surfaced(df, envelope="l1_"), families, allowed="allowed").collect()]
    assert got == [("a", "routed"), (None, "routing_drift"), (None, "routing"), ("b", "routed"), (None, "routing_ambiguous"), ("c", "routed"), ("d", "routed"), (None, "routing_cap"), (None, "routing"), (None, "routing")]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 33])
def test_merkle(n):
    import hashlib

    leaves = [hashlib.sha256(bytes([k])).digest() for k in range(n)]

    def plain(x):
        if len(x) == 1:
            return x[0]
        k = 1
        while 2 * k < len(x):
            k *= 2
        return hashlib.sha256(b"\x01" + plain(x[:k]) + plain(x[k:])).digest()

    want = plain(leaves)
    assert provenance.root(leaves) == want
    for k in range(n):
        path = provenance.proof(leaves, k)
        assert provenance.verify(leaves[k], path, want) and not provenance.verify(leaves[k], path, b"\0" * 32)


def test_evidence(spark):
    import hashlib

    rows = [(s, o, 10 + o, "sha256:" + hashlib.sha256(f"{s}{o}".encode()).hexdigest()) for s in ("x", "y") for o in range(5)]
    df = spark.createDataFrame(rows, "segment string, offset long, length int, raw_hash string").repartition(3)
    got = {r.segment: (r.n, r.root) for r in provenance.roots(df).collect()}
    for s in ("x", "y"):
        leaves = [hashlib.sha256(b"\0siltline-leaf-v1" + s.encode() + o.to_bytes(8, "big") + n.to_bytes(4, "big") + bytes.fromhex(h[7:])).digest() for k, o, n, h in rows if k == s]
        assert got[s] == (5, provenance.root(leaves).hex())
    roots = provenance.roots(df)
    other = spark.createDataFrame([("x", got["x"][1]), ("y", "00"), ("z", "11")], "segment string, root string")
    assert {r.segment: r.finding for r in provenance.verified(other, roots).collect()} == {"y": "tampered", "z": "missing"}
    from pyspark.sql import functions as F

    c = provenance.checkpoints(roots.withColumn("minute", F.length("segment") + F.ascii("segment"))).orderBy("minute").collect()
    plain, prev = [], "0" * 64
    for m, root in sorted((len(k) + ord(k[0]), r) for k, (_, r) in got.items()):
        plain.append((m, 1, root, prev, hashlib.sha256(f"siltline-checkpoint-v1|{m}|1|{root}|{prev}".encode()).hexdigest()))
        prev = plain[-1][-1]
    assert [tuple(x) for x in c] == plain
    assert {r.segment: (r.n, r.first, r.last) for r in provenance.seals(df).collect()} == {"x": (5, 0, 4), "y": (5, 0, 4)}
    local, archive = spark.createDataFrame([(1, "l")], "event_id int, raw string"), spark.createDataFrame([(1, "a"), (2, "a")], "event_id int, raw string")
    assert {(r.event_id, r.raw, r.store) for r in provenance.located(local, archive).collect()} == {(1, "l", "local"), (2, "a", "archive")}
    records = spark.createDataFrame([("p", n, 30, n * 100) for n in range(10)], "peer string, sequence long, bytes long, at long")
    by = {r.sequence: (r.segment, r.offset) for r in provenance.segments(records, most_events=4, most_bytes=100, most_ms=250).collect()}
    assert [by[n][0] for n in range(10)] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3] and by[4][1] == 30


def test_a_rewritten_checkpoint_is_found_at_the_end_of_the_chain(spark):
    rows = [(m, s, hashlib.sha256(f"{m}{s}".encode()).hexdigest()) for m in range(9) for s in range(m % 3 + 1)]
    c = [tuple(r) for r in provenance.checkpoints(spark.createDataFrame(rows, "minute int, segment int, root string")).orderBy("minute").collect()]
    for m in range(9):
        assert c[m][2] == provenance.root([bytes.fromhex(r) for x, _, r in rows if x == m]).hex()
    head, schema = c[-1][4], "minute int, n_segments long, root string, prev string, hash string"
    found = lambda t: [tuple(r) for r in provenance.chain_findings(spark.createDataFrame(t, schema), head).collect()]
    assert found(c) == []
    k, root = 3, hashlib.sha256(b"other").hexdigest()
    one = [*c[:k], (k, c[k][1], root, c[k][3], c[k][4]), *c[k + 1 :]]
    assert found(one) == [(k, "hash")]
    two = [*c[:k], (k, c[k][1], root, c[k][3], provenance.checkpoint_hash(k, c[k][1], root, c[k][3])), *c[k + 1 :]]
    assert found(two) == [(k + 1, "prev")]
    prev, rest = two[k][4], []
    for m, n, r, _, _ in c[k + 1 :]:
        rest.append((m, n, r, prev, provenance.checkpoint_hash(m, n, r, prev)))
        prev = rest[-1][4]
    assert found([*two[: k + 1], *rest]) == [(8, "head")]
    day = provenance.daily(spark.createDataFrame(c, schema).selectExpr("minute div 4 AS day", "minute", "hash"))
    assert {r.day: r.root for r in day.collect()} == {d: provenance.root([bytes.fromhex(x[4]) for x in c if x[0] // 4 == d]).hex() for d in range(3)}
    assert provenance.checkpoints(spark.createDataFrame([], "minute int, segment int, root string")).collect() == []
    assert Program({"parse": {"op": "literal", "text": "a"}}).parser_hash != Program({"parse": {"op": "literal", "text": "a"}, "max_event_bytes": 9}).parser_hash
