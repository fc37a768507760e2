"""Token classes, coercions, timestamps and decoders, as functions and as Columns."""

import pytest
from pyspark.sql import functions as F

from siltline.functions import columns as C
from siltline.functions import values as V

DAY = 86_400_000


@pytest.mark.parametrize(
    ("name", "good", "bad"),
    [
        ("integer", ["0", "-12"], ["+1", "1.0", "", "1 ", "1\n"]),
        ("float", ["1", "-1.5"], ["1.", ".5", "1e3"]),
        ("ipv4", ["10.0.0.1", "255.255.255.255"], ["256.0.0.1", "01.2.3.4", "1.2.3"]),
        ("ipv6", ["::1", "2001:db8::2"], ["10.0.0.1", "::g", "::ffff:10.0.0.1"]),
        ("ip", ["::1", "1.2.3.4"], ["x", "1.2.3.4.5"]),
        ("mac", ["aa:BB:cc:00:11:22", "aa-bb-cc-00-11-22"], ["aabb.cc00.1122", "aa:bb:cc:00:11"]),
        ("url", ["http://x/y?z", "host:80/a"], ["a b", "http://a b"]),
        ("hostname", ["a-b.c1"], ["-a", "a..b", "a_b"]),
        ("uuid", ["12345678-1234-1234-1234-123456789abc"], ["12345678"]),
        ("hex", ["0xAF", "09"], ["0x", "g"]),
        ("word", ["a_b.c:d-e"], ["a b", "é"]),
        ("text", ["", "é\n"], ["a\0"]),
    ],
)
def test_classes(name, good, bad):
    assert all(V.is_class(name, t) for t in good) and not any(V.is_class(name, t) for t in bad)


def test_numbers():
    assert [V.to_int(t) for t in ("12", "+7", "-0", " 1", "1_0", "9223372036854775807", "9223372036854775808", "")] == [12, 7, 0, None, None, 9223372036854775807, None, None]
    assert [V.to_float(t) for t in ("1.5", "1e3", "NaN", "inf", "1d", " 1", "1e999")] == [1.5, 1000.0, None, None, None, None, None]
    assert [V.to_bool(t) for t in ("YES", "on", "0", "maybe")] == [True, True, False, None]
    assert [V.to_mac(t) for t in ("AABB.CC00.1122", "aa-bb-cc-00-11-22", "aa:bb")] == ["aa:bb:cc:00:11:22"] * 2 + [None]
    assert V.to_ip("2001:DB8:0::1") == "2001:db8::1" and V.to_ip("10.0.0.1", "ipv6") is None


def test_timestamps():
    assert V.epoch_auto("1704067200") == (1704067200000, "s") and V.epoch_auto("1704067200123") == (1704067200123, "ms")
    assert V.epoch_auto("1704067200123456") == (1704067200123, "us") and V.epoch_auto("1704067200123456789") == (1704067200123, "ns") and V.epoch_auto("12") is None
    assert V.epoch_frac("1704067200.1235") == 1704067200124 and V.epoch_frac("-0.0005") == -1
    assert V.epoch("-1500", "us") == -1
    assert V.rfc3339("2024-01-01T01:00:00.5+01:00") == 1704067200500 and V.rfc3339("2024-02-30T00:00:00Z") is None
    assert [V.offset_minutes(t) for t in ("Z", "+0130", "-14:00", "+14:01", "1")] == [0, 90, -840, None, None]
    new_year = 1704067200000
    assert V.rfc3164("Jan  1 00:00:00", new_year) == new_year
    assert V.rfc3164("Dec 31 23:00:00", new_year) == new_year - 3_600_000  # over 48 hours late in the ingest's year
    assert V.rfc3164("Jan 2 2020 00:00:00", new_year) == 1577923200000 and V.rfc3164("Feb 30 00:00:00", new_year) is None
    assert V.rfc3164("Jan  1 00:00:00", new_year, zone="Europe/Berlin") == new_year - 3_600_000
    assert V.strptime("24/1/2 13:04:05.25 +0100", "%y/%m/%d %H:%M:%S.%f %z") == 1704197045250
    assert V.strptime("2024 060 11 PM", "%Y %j %I %p") == 1704067200000 + 59 * DAY + 23 * 3_600_000
    assert V.strptime("70", "%y") == 0 and V.strptime("69", "%y") == V.strptime("1969", "%Y") and V.strptime("68", "%y") > 0
    assert V.strptime("2023-02-29", "%Y-%m-%d") is None and V.strptime("12 EST", "%H %Z") is None
    forms = {"to": "timestamp", "formats": [{"kind": "epoch_s"}, {"kind": "rfc3339"}]}
    assert V.coerce("2024-01-01T00:00:00Z", forms) == {"to": "timestamp", "value": new_year, "format": 1}


def test_decoders():
    assert V.decode(b"aGk=", "base64") == b"hi" and V.decode(b"6869", "hex") == b"hi" and V.decode(b"a+b%20c", "url") == b"a+b c"
    assert V.decode("a\\nbé".encode(), "json-string") == "a\nbé".encode() and V.decode(rb"\x41\101\t\"", "c-escape") == b'AA\t"'
    assert V.decode(rb"a\=b\\c\nd", "cef-extension") == b"a=b\\c\nd"
    for raw, kind in ((b"a", "base64"), (b"abc", "hex"), (b"%zz", "url"), (b'"', "json-string"), (rb"\q", "c-escape"), (rb"a\d", "cef-extension"), (b"", "rot13")):
        with pytest.raises(ValueError):
            V.decode(raw, kind)


def test_columns_are_the_functions(spark):
    texts = ["12", "+7", " 1", "", "1e3", "NaN", "1d", "9223372036854775808", "true", "Off", "10.0.0.1", "256.1.1.1", "aa-BB-cc-00-11-22", "a b", "0x1f", "1704067200", None, "-1.5", "1.5", "http://x", "x:1", "::1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    names = [c for c in V.CLASSES if c not in ("ip", "ipv6")]
    rows = df.select("t", C.to_int("t").alias("int"), C.to_float("t").alias("float"), C.to_bool("t").alias("bool"), C.to_mac("t").alias("mac"), *(C.is_class(n, "t").alias(f"c_{n}") for n in names)).collect()
    for r in rows:
        if r.t is None:
            assert set(r) == {None}
            continue
        assert (r.int, r.float, r.bool) == (V.to_int(r.t), V.to_float(r.t), V.to_bool(r.t))
        assert r.mac == V.to_mac(r.t)
        for n in names:
            assert r[f"c_{n}"] == V.is_class(n, r.t), (n, r.t)
    numbers = [0, -1500, 1704067200, 1704067200123, 1704067200123456, 1704067200123456789, None]
    for r in spark.createDataFrame([(n,) for n in numbers], "n long").select("n", C.epoch_auto("n").alias("ms"), C.epoch_precision("n").alias("unit"), C.epoch("n", "us").alias("us"), C.epoch("n", "ns").alias("ns")).collect():
        if r.n is not None:
            assert (r.ms, r.unit) == (V.epoch_auto(str(r.n)) or (None, None))
            assert (r.us, r.ns) == (V.epoch(str(r.n), "us"), V.epoch(str(r.n), "ns"))


def fnv(text):
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 % (1 << 32)
    return h


def test_other_columns(spark):
    one = spark.createDataFrame([("host-é_1.log", "a.b:514", "+0130", 40, 1704067200000)], "name string, peer string, zone string, n int, ms long")
    r = one.select(
        C.fnv1a("name").alias("fnv"), C.shard("name", 7).alias("shard"), C.host_of("peer").alias("host"), C.utc_offset("zone").alias("zone"), C.arity_bucket("n").alias("bucket"), C.event_day("ms").alias("day"), C.event_id("n").alias("id"),
        C.unescape(F.lit('a""b'), '"', "doubled").alias("u1"), C.unescape(F.lit("a\\\\b\\c"), '"', "backslash").alias("u2"), C.lookup(F.lit("x"), {"x": "1"}, "0").alias("l1"), C.lookup(F.lit("y"), {"x": "1"}, "0").alias("l2"), C.lookup(F.lit("y"), {}).alias("l3"),
        C.decode(F.lit("zz"), "hex").alias("bad"), C.decode(F.lit("a\\u00e9"), "json-string").cast("string").alias("js"), C.in_cidr(F.lit("10.0.0.128"), "10.0.0.0/25").alias("out"), C.hec(F.col("ms"), F.col("peer"), F.lit("e")).alias("hec"),
    ).first()
    assert r.fnv == fnv("host-é_1.log") and r.shard == fnv("host-é") % 7
    assert (r.host, r.zone, r.bucket, r.day, r.id) == ("a.b", "+01:30", 40, "20240101", "ev_" + "40".rjust(26, "0"))
    assert (r.u1, r.u2, r.l1, r.l2, r.l3, r.bad, r.js, r.out) == ('a"b', "a\\bc", "1", "0", None, None, "aé", False)
    assert '"time":1.7040672E9' in r.hec or '"time":1704067200' in r.hec
