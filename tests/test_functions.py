"""Expressions against plain Python."""

import base64
import hashlib
import hmac
import urllib.parse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import codec, digest, policy

KEYS = [("m", "a/b", 0), ("mount", "é/ü", 4194304), ("", "x", 2**40 + 7), ("ab", "c", 255), ("a", "bc", 255)]


def want_digest(m, b, o):
    return hashlib.sha256(m.encode() + b"\0" + b.encode() + b"\0" + o.to_bytes(8, "little")).hexdigest()


def test_digest_score_and_bits(spark):
    df = spark.createDataFrame(KEYS, "mount string, blob string, off bigint")
    d = digest.chunk_digest(F.col("mount"), F.col("blob"), F.col("off"))
    got = df.select("mount", "blob", "off", d.alias("d"), digest.hrw_score(F.lit("peer-1"), d).alias("s"), digest.bloom_positions(d, 1 << 23).alias("b")).collect()
    for r in got:
        raw = bytes.fromhex(want_digest(r.mount, r.blob, r.off))
        assert r.d == raw.hex()
        assert int(r.s, 16) == int.from_bytes(hashlib.sha256(b"peer-1" + raw).digest()[:8], "little")
        h1, h2 = (int.from_bytes(raw[i : i + 8], "little") for i in (0, 8))
        assert r.b == [((h1 + i * h2) % 2**64) % (1 << 23) for i in range(4)]
    assert len({r.d for r in got}) == len(KEYS)  # where one part ends and the next begins matters


def test_cluster_hash_ignores_order(spark):
    m = "array<struct<name:string,account:string,container:string,prefix:string>>"
    a = [("m1", "a", "c", ""), ("m2", "a", "c", "p")]
    df = spark.createDataFrame([(a,), (a[::-1],), (a[:1],)], f"mounts {m}")
    h = [r[0] for r in df.select(digest.cluster_hash(F.lit(4096).cast("bigint"), F.lit("tcp"), F.col("mounts"))).collect()]
    body = (4096).to_bytes(8, "little") + b"tcp\0" + b"m1\0a\0c\0\0" + b"m2\0a\0c\0p\0"
    assert h[0] == h[1] == hashlib.sha256(body).hexdigest() != h[2]


FIELDS = {"mount": "docs", "blob": "a/b", "off": 4096, "length": 77, "requester": "n1", "wait_ms": 250, "rid": "req-1"}


def test_request_round_trip_and_faults():
    raw = codec.encode_request(**FIELDS)
    assert codec.decode_request(raw) == FIELDS | {"error": None}
    short = codec.encode_request(**FIELDS | {"rid": ""})
    assert codec.decode_request(short[:-2])["rid"] == "" and codec.decode_request(short[:-6])["wait_ms"] == 0
    assert codec.decode_request(raw + b"\0")["error"] == "trailing"
    assert codec.decode_request(b"\0" + raw[1:])["error"] == "magic"
    assert codec.decode_request(raw[:7])["error"] == "short"
    assert codec.decode_request(None)["error"] == "short"
    assert codec.decode_request(codec.encode_request(**FIELDS | {"rid": "a b"}))["error"] == "rid"
    with pytest.raises(ValueError):
        codec.encode_request(**FIELDS | {"mount": "m" * 256})


@given(st.text(max_size=40), st.text(max_size=90), st.integers(0, 2**63 - 1), st.integers(0, 2**32 - 1))
@settings(max_examples=60, deadline=None)
def test_request_round_trip_any(mount, blob, off, length):
    f = FIELDS | {"mount": mount[:20], "blob": blob, "off": off, "length": length}
    assert codec.decode_request(codec.encode_request(**f)) == f | {"error": None}


def test_columns_read_messages_alike(spark):
    """The expressions against the plain decoders: whole messages, every prefix, and broken ones."""
    raw = codec.encode_request(**FIELDS)
    more = [codec.encode_request(**FIELDS | x) for x in ({"rid": ""}, {"rid": "a b"}, {"mount": "", "blob": "é/ü", "requester": ""}, {"blob": "x" * 300, "off": 2**62, "length": 2**32 - 1})]
    messages = [None, b"", *[raw[:n] for n in range(len(raw) + 1)], raw + b"\0", b"\1" + raw[1:], *more, *[m[:-1] for m in more], *[m[:-7] for m in more], raw.replace(b"m", b"\xff"), raw[:-1] + b"_"]
    got = codec.decode_requests(spark.createDataFrame([(m,) for m in messages], "wire binary")).collect()
    assert [r.request.asDict() for r in got] == [codec.decode_request(m) for m in messages]
    replies = [None, b"", b"\0" * 7, *[codec.encode_response(c, p) for c in (0, 1, 2, 9) for p in (b"", b"a", b"abc")], b"\0" * 9, codec.encode_response(0, b"ab")[:-1]]
    got = spark.createDataFrame([(m,) for m in replies], "wire binary").select(codec.response_fields(F.col("wire"), F.lit(2)).alias("r")).collect()
    assert [r.r.asDict() for r in got] == [codec.decode_response(m, 2) for m in replies]


def test_response():
    assert codec.decode_response(codec.encode_response(0, b"ab"), 2) == {"status": "ok", "length": 2, "error": None}
    assert codec.decode_response(codec.encode_response(0, b"abc"), 2)["error"] == "too_large"
    assert codec.decode_response(codec.encode_response(0, b""), 2)["error"] == "bad_length"
    assert codec.decode_response(codec.encode_response(1, b""), 2)["status"] == "miss"
    assert codec.decode_response(codec.encode_response(9, b""), 2)["error"] == "unknown"
    assert codec.decode_response(b"\0" * 9, 2)["error"] == "mismatch"
    assert codec.decode_response(b"\0", 2)["error"] == "short"


def test_percent_encoding(spark):
    texts = ["abc XYZ019", "a/b?c=é&d+~._-*", "日本", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(codec.percent_encode(F.col("t"))).collect()]
    want = ["".join(c if c.isascii() and c.isalnum() else urllib.parse.quote(c, safe="").replace("~", "%7E").replace("_", "%5F").replace(".", "%2E").replace("-", "%2D") for c in t) for t in texts]
    assert got == want


def test_signature():
    text = codec.text_to_sign("acct", "GET", "/c/b", [("restype", "container"), ("Comp", "list")], {"x-ms-version": "2021", "X-MS-Date": "now", "Range": "bytes=0-1"}, 0)
    assert text == "GET\n\n\n\n\n\n\n\n\n\n\nbytes=0-1\nx-ms-date:now\nx-ms-version:2021\n/acct/c/b\ncomp:list\nrestype:container"
    assert codec.text_to_sign("a", "PUT", "/", [], {}, 12).split("\n")[3] == "12"
    key = base64.b64encode(b"secret").decode()
    assert codec.authorization("acct", key, text) == "SharedKey acct:" + base64.b64encode(hmac.new(b"secret", text.encode(), hashlib.sha256).digest()).decode()


def test_policies(spark):
    df = spark.createDataFrame([(1, None), (2, 3), (3, 100), (12, None)], "attempt int, after int")
    got = [tuple(r) for r in df.select(policy.backoff_ms(F.col("attempt")), policy.retry_delay_ms(F.col("attempt"), F.col("after"))).collect()]
    assert got == [(500, 500), (1000, 3000), (2000, 60000), (30000, 30000)]
    one = spark.range(1)
    sweep = lambda age, me=False: one.select(policy.sweep_state(F.lit(1000 - age), F.lit(1000), F.lit(me))).first()[0]
    assert [sweep(a) for a in (-5, 30, 31, 60, 61)] == ["Alive", "Alive", "Suspect", "Suspect", "Dead"] and sweep(99, True) == "Alive"
    fmt = lambda v: one.select(policy.format_latency(F.lit(v).cast("double"))).first()[0]
    assert [fmt(v) for v in (None, float("inf"), 0.00025, 0.0123, 2.5)] == ["n/a", "+Inf", "250us", "12.3ms", "2.50s"]
    assert one.select(policy.append_sas(F.lit("http://h/p?a=1"), F.lit("?s=2"))).first()[0] == "http://h/p?a=1&s=2"
