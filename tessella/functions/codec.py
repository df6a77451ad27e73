"""Wire formats, percent encoding and request signing, as plain functions and as column expressions of built-ins."""

from __future__ import annotations

import base64
import hashlib
import hmac
import re
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .digest import swap_hex

#: Of the wire format (fixed values).
MAGIC = 0xBC10C001
MOST_PAYLOAD = 64 * 1024 * 1024
STATUS = {0: "ok", 1: "miss", 2: "error"}
MOST_RID = 128

#: Fields in order: name, struct format; s8 and s16 are strings behind a length of so many bits.
LAYOUT = (("magic", "I"), ("mount", "s8"), ("blob", "s16"), ("off", "Q"), ("length", "I"), ("requester", "s16"), ("wait_ms", "I"), ("rid", "s16"))
#: What a message may lack at its end, and what then holds.
OPTIONAL = {"wait_ms": (4, 0), "rid": (2, "")}
REQUEST = "mount string, blob string, off bigint, length bigint, requester string, wait_ms bigint, rid string, error string"
_RID = re.compile("[A-Za-z0-9-]*")


def encode_request(**fields) -> bytes:
    """All fields of LAYOUT but magic, big-endian."""
    out = b""
    for name, kind in LAYOUT:
        v = MAGIC if name == "magic" else fields[name]
        if kind[0] == "s":
            raw = v.encode()
            if len(raw) >= 1 << int(kind[1:]) or name == "rid" and len(raw) > MOST_RID:
                raise ValueError(f"{name} is too long")
            out += len(raw).to_bytes(int(kind[1:]) // 8, "big") + raw
        else:
            out += struct.pack(">" + kind, v)
    return out


def decode_request(raw: bytes | None) -> dict:
    """LAYOUT's fields, or error: short, magic, utf8, rid, trailing."""
    names = [f.split()[0] for f in REQUEST.split(", ")]
    got, rest = dict.fromkeys(names), raw or b""

    def take(n: int) -> bytes:
        nonlocal rest
        if len(rest) < n:
            raise EOFError
        head, rest = rest[:n], rest[n:]
        return head

    try:
        for name, kind in LAYOUT:
            if name in OPTIONAL and len(rest) < OPTIONAL[name][0]:
                got[name] = OPTIONAL[name][1]
                continue
            if kind[0] == "s":
                got[name] = take(int.from_bytes(take(int(kind[1:]) // 8), "big")).decode()
            else:
                got[name] = struct.unpack(">" + kind, take(struct.calcsize(">" + kind)))[0]
            if name == "magic" and got.pop(name) != MAGIC:
                return dict.fromkeys(names) | {"error": "magic"}
        why = "rid" if len(got["rid"]) > MOST_RID or not _RID.fullmatch(got["rid"]) else "trailing" if rest else None
    except EOFError:
        why = "short"
    except UnicodeDecodeError:
        why = "utf8"
    return dict.fromkeys(names) | {"error": why} if why else got


def encode_response(status: int, payload: bytes) -> bytes:
    if len(payload) > MOST_PAYLOAD:
        raise ValueError("the payload is too large")
    return struct.pack("<II", status, len(payload)) + payload


def decode_response(raw: bytes | None, expected: int) -> dict:
    """status and payload length, or error: short, mismatch, bad_length, too_large, unknown."""
    if raw is None or len(raw) < 8:
        return {"status": None, "length": None, "error": "short"}
    code, n = struct.unpack("<II", raw[:8])
    if n != len(raw) - 8:
        return {"status": None, "length": n, "error": "mismatch"}
    name = STATUS.get(code)
    why = None if name else "unknown"
    if name == "ok":
        why = "bad_length" if not 0 < n <= MOST_PAYLOAD else "too_large" if n > expected else None
    return {"status": name, "length": n, "error": why}


def _number(raw: Column, at: Column, size: int) -> Column:
    """`size` bytes from `at` on, big-endian."""
    return F.conv(F.hex(F.substring(raw, at + 1, F.lit(size))), 16, 10).try_cast("bigint")


def decode_requests(messages: DataFrame, column: str = "wire") -> DataFrame:
    """messages with LAYOUT's fields and error in a struct `request`, as decode_request() reads them; field by field in built-ins, where the
    place reached and the first error are columns of their own."""
    raw, size, at, error = F.col("__raw"), F.col("__size"), F.col("__at"), F.col("__error")
    d = messages.withColumns({"__raw": F.coalesce(F.col(f"`{column}`"), F.lit(b""))})
    d = d.withColumns({"__size": F.octet_length("__raw"), "__at": F.lit(0), "__error": F.lit(None).cast("string")})
    for name, kind in LAYOUT:
        least, default = OPTIONAL.get(name, (0, None))
        # A missing field at the end takes no bytes.
        absent = size - at < least
        if kind[0] == "s":
            head = int(kind[1:]) // 8
            d = d.withColumn("__n", F.when(size >= at + head, _number(raw, at, head)).cast("int"))
            whole = F.col("__n").isNotNull() & (size >= at + head + F.col("__n"))
            d = d.withColumn("__text", F.when(whole, F.substring(raw, at + head + 1, F.col("__n")).cast("string")))
            value, step = F.col("__text"), F.col("__n") + head
            wrong = F.when(~whole, "short").when(~F.is_valid_utf8(F.col("__text")), "utf8")
        else:
            width = struct.calcsize(">" + kind)
            whole = size >= at + width
            value, step = F.when(whole, _number(raw, at, width)), F.lit(width)
            wrong = F.when(~whole, "short")
            if name == "magic":
                wrong = wrong.when(_number(raw, at, width) != MAGIC, "magic")
        d = d.withColumns(
            {
                f"__{name}": F.when(absent, F.lit(default)).otherwise(value) if least else value,
                "__error": F.coalesce(error, F.when(~absent, wrong) if least else wrong),
                "__at": F.when(absent, at).otherwise(at + F.coalesce(step, F.lit(0))) if least else at + F.coalesce(step, F.lit(0)),
            }
        )
    rid = F.col("__rid")
    late = F.when((F.length(rid) > MOST_RID) | ~rid.rlike(f"^(?:{_RID.pattern})$"), "rid").when(at < size, "trailing")
    d = d.withColumn("__error", F.coalesce(error, late))
    fields = [f.split() for f in REQUEST.split(", ")[:-1]]
    out = F.struct(*[F.when(error.isNull(), F.col(f"__{n}")).cast(t).alias(n) for n, t in fields], error.alias("error"))
    return d.select(*[F.col(f"`{c}`") for c in messages.columns], out.alias("request"))


def response_fields(raw: Column, expected: Column) -> Column:
    """The struct that decode_response() reads, of built-ins."""
    word = lambda at: F.conv(swap_hex(F.hex(F.substring(raw, at + 1, 4)), 4), 16, 10).cast("bigint")
    code, n = word(0), word(4)
    name = F.when(code == 0, STATUS[0]).when(code == 1, STATUS[1]).when(code == 2, STATUS[2])
    short = raw.isNull() | (F.octet_length(raw) < 8)
    wrong = F.when(short, "short").when(n != F.octet_length(raw) - 8, "mismatch").when(name.isNull(), "unknown")
    wrong = wrong.when((code == 0) & ((n <= 0) | (n > MOST_PAYLOAD)), "bad_length").when((code == 0) & (n > expected), "too_large")
    mismatch = ~short & (n != F.octet_length(raw) - 8)
    return F.struct(F.when(~short & ~mismatch, name).alias("status"), F.when(~short, n).alias("length"), wrong.alias("error"))


def percent_encode(text):
    """Every byte that is no ASCII letter or digit as %XX: the built-in encoder, which leaves a blank as + and four marks as they are."""
    out = F.url_encode(text)
    for mark, code in (("+", "%20"), (".", "%2E"), ("-", "%2D"), ("*", "%2A"), ("_", "%5F")):
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


#: Headers that are signed, in order; the content length stands between the second and the third (fixed values).
SIGNED = ("content-encoding", "content-language", "content-md5", "content-type", "date", "if-modified-since", "if-match", "if-none-match", "if-unmodified-since", "range")


def text_to_sign(account: str, verb: str, path: str, query: list[tuple[str, str]], headers: dict[str, str], content_length: int | None) -> str:
    """The verb, the signed headers with an empty line for each that is absent or a length of 0, the x-ms headers and the resource, both by name."""
    h = {k.lower(): v for k, v in headers.items()}
    lines = [verb, *[h.get(n, "") for n in SIGNED]]
    lines.insert(3, str(content_length) if content_length else "")
    own = sorted((k, v) for k, v in h.items() if k.startswith("x-ms-"))
    asked = sorted(((k.lower(), v) for k, v in query), key=lambda kv: kv[0])
    return "\n".join([*lines, "\n".join(f"{k}:{v}" for k, v in own), "\n".join([f"/{account}{path}", *[f"{k}:{v}" for k, v in asked]])])


def authorization(account: str, secret: str, text: str) -> str:
    mac = hmac.digest(base64.b64decode(secret), text.encode(), "sha256")
    return f"SharedKey {account}:{base64.b64encode(mac).decode()}"


def key_pads(secret: str) -> tuple[bytes, bytes]:
    """The inner and the outer pad of HMAC-SHA256 for a base64 key."""
    key = base64.b64decode(secret)
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def authorization_of(account: str, secret: str, text):
    """The same as authorization(), of a column: the pads are constants, so SHA-256 is all it takes."""
    inner, outer = key_pads(secret)
    digest = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(text, "UTF-8")), 256))
    return F.concat(F.lit(f"SharedKey {account}:"), F.base64(F.unhex(F.sha2(F.concat(F.lit(outer), digest), 256))))
