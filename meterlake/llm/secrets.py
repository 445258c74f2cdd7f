"""Secret scan with structural confirmation.

Pattern hits (assignments, access ids, long hex) are reported as they are. What merely looks like an encoded
key is decoded first and reported only if its structure holds: DER key encodings whose nested lengths add up down to
the key inside the octet string, OpenSSH private-key containers, and signed tokens whose header and payload are JSON
objects with an algorithm. A PEM block is confirmed by its body whatever its name says. Keys may stand in strings with
escaped line ends, and PEM bodies may begin with RFC 1421 headers; where those name a cipher, the body has no structure
but that: it must be base64 of whole blocks of that cipher.

Edge cases: a null or empty text has no spans and the digest of the empty string; offsets are code points, ends
exclusive; repeated rows give repeated results; columns of the input other than doc_id and text are not read;
an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.common import short_batches, table

BASE_KINDS = ("assign", "access", "hex")
CONFIRMED_KINDS = ("pem", "der", "hexder", "openssh", "jwt")
RANK = {kind: i for i, kind in enumerate(BASE_KINDS + CONFIRMED_KINDS)}

# Letters of the names may be in either case, in ASCII only.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: A line end, and a character of a PEM body, as they are or escaped in a string, once or more.
LINE = r"(?:\\+r\\+n|\\+[nr]|\\+u000[AaDd]|\r\n|[\r\n])"
BODY = r"(?:[A-Za-z0-9+/=\s]|\\+(?:[nrt/\s]|u00[0-9A-Fa-f]{2}))"
PEM = re.compile(rf"-----BEGIN ([A-Z0-9 ]{{0,40}}PRIVATE KEY)-----((?:\s|\\+[nrt])*+(?:[A-Za-z0-9-]{{1,60}}:[^\r\n\\]{{0,400}}{LINE}(?:[ \t][^\r\n\\]{{1,400}}{LINE})*)*)({BODY}{{16,}}+)-----END \1-----")
ESCAPE = re.compile(r"\\+(?:u00([0-9A-Fa-f]{2})|([nrt/\s]))")
ENCRYPTED = re.compile(r"Proc-Type:[ \t]*4[ \t]*,[ \t]*ENCRYPTED", re.IGNORECASE)
CIPHER = re.compile(r"DEK-Info:[ \t]*([A-Za-z0-9-]{3,40})[ \t]*,[ \t]*([0-9A-Fa-f]{16,64})(?![0-9A-Fa-f])", re.IGNORECASE)
#: Where a candidate begins: not within a run of its letters, but an escape sequence ends such a run.
BEGINS = r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nrt])|(?<=\\u00[0-9A-Fa-f]{2}))"
#: JSON objects begin with a brace or white space, so e, I, C or D in base64; the shortest header has 11 bytes.
JWT = re.compile(BEGINS.replace("+/", "") + r"([eICD][A-Za-z0-9_-]{14,}+)\.([eICD][A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]*)")
#: DER sequences begin with 0x30, which is M in base64; OpenSSH containers with their magic.
ENCODED = re.compile(BEGINS + r"(?:M[A-Z]|b3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/_-]{30,}={0,2}")
HEX_DER = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}")
OPENSSH_MAGIC = b"openssh-key-v1\0"


def decoded(text: str) -> bytes:
    """The bytes of base64 in either alphabet, padded or not; empty if it is none."""
    flat = "".join(text.split()).replace("-", "+").replace("_", "/").rstrip("=")
    if len(flat) % 4 == 1:
        return b""
    try:
        return base64.b64decode(flat + "=" * (-len(flat) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def unescaped(body: str) -> str:
    """The body of a key with its escape sequences resolved."""
    return ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else m[2] if m[2] == "/" else " ", body) if "\\" in body else body


def enciphered(headers: str, data: bytes) -> bool:
    """RFC 1421 headers name a cipher and its start value, and the bytes are whole blocks of it."""
    cipher = CIPHER.search(headers)
    if not data or not cipher or not ENCRYPTED.search(headers):
        return False
    return len(data) % (16 if cipher[1].upper().startswith(("AES", "CAMELLIA", "SEED")) else 8) == 0


def pem_key(headers: str, body: str) -> bool:
    """A key encoding, a container, or what the headers call encrypted."""
    data = decoded(unescaped(body))
    return bool(key_encoding(data)) or openssh(data) or enciphered(headers, data)


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the DER element at a place; None if lengths do not fit."""
    if at + 2 > end:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length & 0x80:
        n = length & 0x7F
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        length, at = int.from_bytes(data[at : at + n], "big"), at + n
        if length < 0x80:
            return None
    return (tag, at, at + length) if at + length <= end else None


def children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """Elements that fill a content exactly."""
    found = []
    while start < end:
        if not (x := element(data, start, end)):
            return None
        found.append(x)
        start = x[2]
    return found


def content(data: bytes, x: tuple[int, int, int]) -> bytes:
    return data[x[1] : x[2]]


def tagged(data: bytes, tags: list[int] | None, start: int = 0, end: int | None = None) -> list[tuple[int, int, int]] | None:
    """The elements of a content if their tags begin with these."""
    inner = children(data, start, len(data) if end is None else end)
    return inner if inner and (tags is None or [x[0] for x in inner][: len(tags)] == tags) else None


def algorithm(data: bytes, x: tuple[int, int, int]) -> bytes | None:
    """The object identifier of an algorithm with at most one parameter, whose own elements add up."""
    inner = tagged(data, [0x06], x[1], x[2])
    if not inner or len(inner) > 2 or inner[0][1] == inner[0][2]:
        return None
    if inner[1:] and inner[1][0] == 0x30 and not children(data, inner[1][1], inner[1][2]):
        return None
    return content(data, inner[0])


def integers(data: bytes, some: list[tuple[int, int, int]]) -> bool:
    """None is empty, and none has a needless leading zero."""
    return all(a < b and not (b - a > 1 and data[a] == 0 and data[a + 1] < 0x80) for _, a, b in some)


def rsa_or_dsa(data: bytes, inner: list[tuple[int, int, int]]) -> str | None:
    tags = [x[0] for x in inner]
    if tags[:9] == [0x02] * 9 and integers(data, inner[:9]):
        version, primes = content(data, inner[0]), inner[9:]
        if version == b"\0" and not primes:
            return "pkcs1"
        # More primes: triples of integers.
        if version == b"\1" and [t for t, *_ in primes] == [0x30] and (more := children(data, *primes[0][1:])):
            return "pkcs1" if all(len(tagged(data, [0x02] * 3, a, b) or ()) == 3 for _, a, b in more) else None
    if tags == [0x02] * 6 and integers(data, inner) and content(data, inner[0]) == b"\0":
        return "dsa"
    return None


def sec1(data: bytes, inner: list[tuple[int, int, int]]) -> bool:
    """Version 1, the secret, then the curve and the public point, each of them optional."""
    if [x[0] for x in inner[:2]] != [0x02, 0x04] or content(data, inner[0]) != b"\1" or not 14 <= inner[1][2] - inner[1][1] <= 72:
        return False
    rest = [x[0] for x in inner[2:]]
    if rest not in ([], [0xA0], [0xA1], [0xA0, 0xA1]):
        return False
    for tag, a, b in inner[2:]:
        held = children(data, a, b)
        if not held or len(held) != 1 or held[0][0] not in ((0x06, 0x30) if tag == 0xA0 else (0x03,)):
            return False
    return True


# Object identifiers (DER) of algorithms whose keys have a structure of their own.
RSA = (bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a864886f70d01010a"))
EC = (bytes.fromhex("2a8648ce3d0201"),)


def inside(oid: bytes, key: bytes) -> bool:
    """What an octet string holds is the key of its algorithm: RSA, elliptic curve, or one element (a number, a string, a sequence)."""
    top = element(key, 0, len(key))
    if not top or top[2] != len(key) or top[1] == top[2]:
        return False
    inner = children(key, top[1], top[2]) if top[0] == 0x30 else None
    if oid in RSA:
        return bool(inner) and rsa_or_dsa(key, inner) == "pkcs1"
    if oid in EC:
        return bool(inner) and sec1(key, inner)
    return bool(inner) if top[0] == 0x30 else top[0] in (0x02, 0x04)


def key_encoding(data: bytes) -> str | None:
    """Name of the private-key structure that the bytes are, nested lengths included."""
    if not (top := element(data, 0, len(data))) or top[0] != 0x30 or top[2] != len(data):
        return None
    if not (inner := children(data, top[1], top[2])):
        return None
    tags = [x[0] for x in inner]
    if tags[:3] == [0x02, 0x30, 0x04] and set(tags[3:]) <= {0xA0, 0x81, 0xA1} and content(data, inner[0]) in (b"\0", b"\1"):
        oid = algorithm(data, inner[1])
        return "pkcs8" if oid and inside(oid, content(data, inner[2])) else None
    if tags == [0x30, 0x04]:
        return "pkcs8-encrypted" if algorithm(data, inner[0]) and inner[1][2] - inner[1][1] >= 16 else None
    return "sec1" if sec1(data, inner) else rsa_or_dsa(data, inner)


def lengths(data: bytes, at: int, n: int) -> list[bytes] | None:
    """n strings with a length of four bytes before each, from a place on."""
    found = []
    for _ in range(n):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        found.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return found


def openssh(data: bytes) -> bool:
    """Cipher, derivation, options, key count, public keys and private block, each with its length; all bytes are used.

    The private block is whole cipher blocks; without a cipher it begins with the same number twice.
    """
    at = len(OPENSSH_MAGIC)
    if not data.startswith(OPENSSH_MAGIC) or not (head := lengths(data, at, 3)):
        return False
    at += sum(4 + len(x) for x in head)
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    # Each key has four bytes at least.
    if not 1 <= keys <= len(data) // 4 or not (blocks := lengths(data, at, keys + 1)):
        return False
    if at + sum(4 + len(x) for x in blocks) != len(data) or not all(lengths(x, 0, 1) for x in blocks[:-1]):
        return False
    secret = blocks[-1]
    return len(secret) >= 16 and len(secret) % 8 == 0 and (head[0] != b"none" or secret[:4] == secret[4:8])


def signed_token(header: str, payload: str) -> bool:
    """Both parts decode to JSON objects and the header names an algorithm."""
    try:
        head, body = (json.loads(decoded(x).decode("utf-8")) for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if "-----BEGIN" in text:
        found += [(m.start(), m.end(), "pem") for m in PEM.finditer(text) if pem_key(m[2], m[3])]
    for m in ENCODED.finditer(text):
        data = decoded(m[0])
        if openssh(data):
            found.append((m.start(), m.end(), "openssh"))
        elif key_encoding(data):
            found.append((m.start(), m.end(), "der"))
    found += [(m.start(), m.end(), "hexder") for m in HEX_DER.finditer(text) if len(m[0]) % 2 == 0 and key_encoding(bytes.fromhex(m[0]))]
    return found + [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if signed_token(m[1], m[2])]


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda x: (x[0], RANK[x[2]], x[1]))


SPANS = "array<struct<start:int,end:int,kind:string>>"


def _spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for some in texts:
        found = [ordered(base_spans(t) + confirmed_spans(t)) if t else [] for t in some]
        yield pd.Series([[{"start": a, "end": b, "kind": k} for a, b, k in x] for x in found])


def scan(docs: DataFrame) -> DataFrame:
    """The same rows and columns, and the ordered spans of each text; the rows stay in their partitions."""
    return short_batches(docs).withColumn("spans", F.pandas_udf(_spans, SPANS)("text"))


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of each document, without its text."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    say = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", "spans", base.alias("base")).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(say("base"), 256).alias("base_sha256"),
        say("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_confirmed"),
    )


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span replaced; overlapping spans become one mark."""
    out, at = [], 0
    last = -1
    for start, end, _ in ordered(base_spans(text) + confirmed_spans(text)):
        if start < last:
            last = max(last, end)
            at = last
            continue
        out += [text[at:start], mark]
        at = last = end
    return "".join(out) + text[at:]


def _redacted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for some in texts:
        yield pd.Series([redacted(t) if t else t for t in some], dtype=object)


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns; secrets in text are replaced by a mark, clean texts stay as they are."""
    return short_batches(docs).withColumn("text", F.pandas_udf(_redacted, "string")("text"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
