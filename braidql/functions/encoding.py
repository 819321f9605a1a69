"""Encodings, digests and identifiers."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import Typed, register, text

# Fixed value: the alphabet of base58.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def base58_encode(data: bytes) -> str:
    value, out = int.from_bytes(data, "big"), ""
    while value:
        value, digit = divmod(value, 58)
        out = BASE58[digit] + out
    return BASE58[0] * (len(data) - len(data.lstrip(b"\0"))) + out


def base58_decode(coded: str) -> bytes:
    value = 0
    for c in coded:
        value = value * 58 + BASE58.index(c)
    return b"\0" * (len(coded) - len(coded.lstrip(BASE58[0]))) + value.to_bytes((value.bit_length() + 7) // 8, "big")


def _as_udf(name: str, fn) -> None:
    """Encodings without a builtin: Arrow batches."""

    def build(x: Typed) -> Column:
        def run(values: pa.Array) -> pa.Array:
            return pa.array([None if v is None else fn(v) for v in values.to_pylist()], pa.string())

        run.__annotations__ = {"values": pa.Array, "return": pa.Array}  # read by Spark as classes
        return F.arrow_udf(run, "string")(text(x))

    register(name)(build)


def _pad32(s: str) -> str:
    return s + "=" * (-len(s) % 8)


_as_udf("base32_encode", lambda s: base64.b32encode(s.encode()).decode().rstrip("="))
_as_udf("base32_decode", lambda s: base64.b32decode(_pad32(s)).decode())
_as_udf("base58_encode", lambda s: base58_encode(s.encode()))
_as_udf("base58_decode", lambda s: base58_decode(s).decode())


@register("base64_encode", each="str")
def _base64(x: Typed) -> Column:
    return F.regexp_replace(F.base64(F.encode(text(x), "UTF-8")), r"[\r\n]", "")


@register("base64_decode", each="str")
def _unbase64(x: Typed) -> Column:
    return F.decode(F.unbase64(x.col), "UTF-8")


@register("md5", each="str")
def _md5(x: Typed) -> Column:
    return F.md5(F.encode(text(x), "UTF-8"))


@register("sha1", "SHA1", each="str")
def _sha1(x: Typed) -> Column:
    return F.sha1(F.encode(text(x), "UTF-8"))


@register("sha256", each="str")
def _sha256(x: Typed) -> Column:
    return F.sha2(F.encode(text(x), "UTF-8"), 256)


@register("sha512", "SHA512", each="str")
def _sha512(x: Typed) -> Column:
    return F.sha2(F.encode(text(x), "UTF-8"), 512)


@register("generate_uuidv4", low=0, high=1)
def _uuid4(*_: Typed) -> Column:
    return F.uuid()


@register("generate_uuidv7", low=0, high=1)
def _uuid7(*_: Typed) -> Column:
    """Time bits from the clock, the rest from two random longs: no Python needed."""
    stamp = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    rest = F.regexp_replace(F.uuid(), "-", "")
    variant = F.substring(F.lit("89ab"), F.floor(F.rand() * 4).cast("int") + 1, F.lit(1))
    return F.concat_ws("-", F.substring(stamp, 1, 8), F.substring(stamp, 9, 4), F.concat(F.lit("7"), F.substring(rest, 1, 3)), F.concat(variant, F.substring(rest, 4, 3)), F.substring(rest, 18, 12))
