"""Secret scans with structural confirmation: encoded candidates are decoded and parsed before they are reported.

Three kinds go by their text alone: ``assign`` (a keyword, a sign and a value of six or more characters),
``access`` (access key ids) and ``hex`` (24 or more lower-case hexadecimal digits). Three more are reported only
when what they encode has the structure of a secret:

* ``pem``: an armoured private key whose body decodes to a key encoding (or, encrypted the old way, to whole
  cipher blocks); OpenPGP armour must hold a chain of packets that starts with a secret key.
* ``key``: a base64 run (also wrapped over lines) or hex run that decodes to a private key: DER whose nested
  lengths all add up (RSA, DSA, EC, PKCS#8 plain and encrypted, PKCS#12), the OpenSSH container, or the text of a
  ``pem`` or ``jwt``.
* ``jwt``: three parts whose header is a JSON object with a known algorithm, whose payload is one too, and whose
  signature has that algorithm's length.

Public keys, certificates, checksums and random base64 have none of these structures and are not reported.
A text is a row of its own: no shuffle, nothing gathered; each scan is linear in the text.

Defined results: a null or empty text has no spans; positions are code points, the end exclusive; spans may
overlap across kinds, never within one; a ``key`` or ``jwt`` inside a ``pem`` is part of it. Repeated rows and
null ids give a row each; extra columns are not used, whatever their names; an empty table gives no rows.
Not found: url-safe base64 keys, keys in JSON form, hex with separators, keys glued to further base64 characters.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: In the order in which spans with the same start are listed.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem", "key", "jwt")
RANK = {k: n for n, k in enumerate(KINDS)}
SPANS = "array<struct<kind:string,start:long,end:long,detail:string>>"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
LEAST_VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40})-----")
RUN = re.compile(r"[A-Za-z0-9+/]{16,}(?:\r?\n[A-Za-z0-9+/]{16,})*")
REST = re.compile(r"(?:\r?\n[A-Za-z0-9+/]{1,15})?={0,2}")
PAD = re.compile(r"={0,2}")
HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[Ff]70656[Ee]|2[Dd]2[Dd]2[Dd]|65794[Aa])[0-9A-Fa-f]{26,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")

#: Object identifiers (DER bodies), signature lengths in bytes, the OpenSSH container's first bytes.
RSA, EC, DSA = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"), bytes.fromhex("2a8648ce380401")
EDWARDS = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
PKCS7 = bytes.fromhex("2a864886f70d0107")
SIGNATURES = {"HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES256K": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114), "none": (0, 0)}
SIGNATURES |= {f"{a}{n}": (128, 2048) for a in ("RS", "PS") for n in (256, 384, 512)}
OPENSSH = b"openssh-key-v1\0"

Items = list[tuple[int, int, int]]


def tlv(b: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end of the body) of the DER element at ``at``; None if its length is malformed or runs past ``end``."""
    if at + 2 > end:
        return None
    tag, n, at = b[at], b[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or not b[at]:
            return None
        n, at = int.from_bytes(b[at : at + k], "big"), at + k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def items(b: bytes, at: int, end: int) -> Items | None:
    """Elements that fill ``at`` to ``end`` exactly; None if their lengths don't add up."""
    out: Items = []
    while at < end:
        x = tlv(b, at, end)
        if x is None:
            return None
        out.append(x)
        at = x[2]
    return out


def sequence(b: bytes) -> Items | None:
    """Elements of the DER sequence that is all of ``b``."""
    x = tlv(b, 0, len(b))
    return items(b, x[1], x[2]) if x and x[0] == 0x30 and x[2] == len(b) else None


def _rsa(b: bytes, parts: Items) -> bool:
    """Version, modulus, two exponents, two primes and the three helpers, in sizes that fit each other."""
    if len(parts) < 9 or any(t != 2 for t, _, _ in parts[:9]):
        return False
    n, e, d, p, q = (z - a for _, a, z in parts[1:6])
    return n >= 64 and e < n and d <= n + 1 and abs(p + q - n) <= 2


def _ec(b: bytes, parts: Items) -> bool:
    """Version 1, the secret number, then nothing or tagged curve and public point whose lengths nest."""
    if len(parts) < 2 or parts[1][0] != 4 or not 16 <= parts[1][2] - parts[1][1] <= 72:
        return False
    return all(t in (0xA0, 0xA1) and items(b, a, z) for t, a, z in parts[2:])


def _octets(b: bytes, oid: bytes, a: int, z: int) -> bool:
    """Whether the secret part of a PKCS#8 key fits its algorithm."""
    inner = b[a:z]
    if oid in EDWARDS:
        x = tlv(inner, 0, len(inner))
        return x is not None and x[0] == 4 and x[2] == len(inner) and x[2] - x[1] == EDWARDS[oid]
    if oid in (RSA, EC):
        return der_key(inner) == ("rsa" if oid == RSA else "ec")
    return bool(items(inner, 0, len(inner)))


def _algorithm(b: bytes, part: tuple[int, int, int]) -> bytes | None:
    """The object identifier that leads a sequence."""
    inner = items(b, part[1], part[2]) if part[0] == 0x30 else None
    return b[inner[0][1] : inner[0][2]] if inner and inner[0][0] == 6 else None


def der_key(b: bytes) -> str | None:
    """Which private key ``b`` encodes: rsa, dsa, ec, pkcs8, pkcs8-encrypted or pkcs12; None if none."""
    parts = sequence(b)
    if not parts or len(parts) < 2:
        return None
    (t, a, z), second = parts[0], parts[1]
    if t == 0x30:
        oid = _algorithm(b, parts[0])
        whole = len(parts) == 2 and second[0] == 4 and second[2] - second[1] >= 8
        return "pkcs8-encrypted" if whole and oid and oid.startswith(PASSWORD_BASED) else None
    if t != 2 or z - a != 1:
        return None
    version = b[a]
    if second[0] == 0x30:
        oid = _algorithm(b, second)
        if version == 3:
            return "pkcs12" if oid and oid.startswith(PKCS7) else None
        good = version <= 1 and oid and len(parts) >= 3 and parts[2][0] == 4 and _octets(b, oid, *parts[2][1:])
        return "pkcs8" if good and all(x[0] in (0xA0, 0xA1, 0x81) for x in parts[3:]) else None
    if version <= 1 and _rsa(b, parts):
        return "rsa"
    if version == 1 and _ec(b, parts):
        return "ec"
    if version == 0 and len(parts) == 6 and all(x[0] == 2 for x in parts) and second[2] - second[1] >= 64:
        return "dsa"
    return None


def openssh_key(b: bytes) -> bool:
    """The OpenSSH container: strings whose lengths nest, as many public keys as announced, two equal check numbers."""
    if not b.startswith(OPENSSH):
        return False
    at, end, number = len(OPENSSH), len(b), lambda x: int.from_bytes(x, "big")

    def string() -> bytes | None:
        nonlocal at
        n = number(b[at : at + 4])
        if at + 4 + n > end:
            return None
        out, at = b[at + 4 : at + 4 + n], at + 4 + n
        return out

    cipher, kdf, options = string(), string(), string()
    if not cipher or not kdf or options is None or at + 4 > end:
        return False
    keys, at = number(b[at : at + 4]), at + 4
    if not keys or keys * 4 > end or any(not string() for _ in range(keys)):
        return False
    secret = string()
    return bool(secret) and at == end and (cipher != b"none" or len(secret) > 8 and secret[:4] == secret[4:8])


def pgp_key(b: bytes) -> bool:
    """OpenPGP packets that fill ``b``, the first a secret key."""
    at, first = 0, None
    while at < len(b):
        head = b[at]
        if not head & 0x80 or at + 2 > len(b):
            return False
        tag, n, k = (head & 0x3F, b[at + 1], 2) if head & 0x40 else (head >> 2 & 0xF, 0, 1)
        if not head & 0x40:
            size = (1, 2, 4, 0)[head & 3]
            n, k = int.from_bytes(b[at + 1 : at + 1 + size], "big"), 1 + size
            if not size:
                return False
        elif 192 <= n < 224:
            n, k = (n - 192 << 8) + int.from_bytes(b[at + 2 : at + 3], "big") + 192, 3
        elif n == 255:
            n, k = int.from_bytes(b[at + 2 : at + 6], "big"), 6
        elif n >= 224:
            return False
        first = tag if first is None else first
        at += k + n
    return at == len(b) and first == 5


def decode64(s: str) -> bytes | None:
    """Base64 of either alphabet, padded or not; None if it isn't."""
    s = s.rstrip("=")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), b"-_" if "-" in s or "_" in s else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def pem_body(label: str, body: str) -> str | None:
    """What an armoured private key holds; None if its body has no such structure."""
    lines = re.split(r"(?:\r|\n|\\r|\\n)+", body)
    headers = [x for x in lines if ":" in x]
    data = "".join(x.strip() for x in lines if ":" not in x)
    if label == "PGP PRIVATE KEY BLOCK":
        data = re.sub(r"=[A-Za-z0-9+/]{4}$", "", data)
    got = decode64("".join(data.split()))
    if not got:
        return None
    if label == "PGP PRIVATE KEY BLOCK":
        return "pgp" if pgp_key(got) else None
    if got.startswith(OPENSSH):
        return "openssh" if openssh_key(got) else None
    if any("ENCRYPTED" in x for x in headers):
        return "pem-encrypted" if len(got) % 8 == 0 else None
    return der_key(got)


def pems(text: str) -> Iterator[tuple[int, int, str]]:
    """Confirmed armoured private keys."""
    m = BEGIN.search(text)
    while m:
        after = BEGIN.search(text, m.end())
        label, close = m[1], f"-----END {m[1]}-----"
        # a block ends before the next one begins
        end = text.find(close, m.end(), after.start() if after else len(text)) if label.endswith(("PRIVATE KEY", "PRIVATE KEY BLOCK")) else -1
        if end >= 0 and (detail := pem_body(label, text[m.end() : end])):
            yield m.start(), end + len(close), detail
        m = after


def jwts(text: str) -> Iterator[tuple[int, int, str]]:
    """Confirmed signed tokens."""
    for m in JWT.finditer(text):
        try:
            header, payload = (json.loads(decode64(m[k]) or b"") for k in (1, 2))
        except (ValueError, RecursionError):
            continue
        alg = header.get("alg") if isinstance(header, dict) else None
        low, high = SIGNATURES.get(alg, (1, 0)) if isinstance(alg, str) else (1, 0)
        signature = decode64(m[3])
        if isinstance(payload, dict) and signature is not None and low <= len(signature) <= high:
            yield m.start(), m.end(), alg


def decoded(b: bytes) -> str | None:
    """Which secret some decoded bytes are as a whole."""
    if b[:1] == b"\x30":
        return der_key(b)
    if b.startswith(OPENSSH):
        return "openssh" if openssh_key(b) else None
    if b.startswith((b"-----BEGIN", b"eyJ")):
        try:
            t = b.decode("ascii").strip()
        except UnicodeDecodeError:
            return None
        found = [d for a, z, d in (*pems(t), *jwts(t))]
        return f"text:{found[0]}" if found else None
    return None


def _fits(head: bytes, chars: int) -> bool:
    """Whether a run of so many base64 characters can be what its first 12 bytes announce."""
    if head[0] != 0x30:
        return head.startswith((OPENSSH[:12], b"-----BEGIN", b"eyJ"))
    n, k = head[1], 2
    if n & 0x80:
        n, k = int.from_bytes(head[2 : 2 + (n & 0x7F)], "big"), 2 + (n & 0x7F)
    return -(-(n + k) * 4 // 3) == chars


def keys(text: str) -> Iterator[tuple[int, int, str]]:
    """Confirmed base64 and hex encodings of private keys."""
    for m in RUN.finditer(text):
        tail = REST.match(text, m.end())
        lines = [m.start(), *(x.end() for x in re.finditer("\n", m[0]))]
        starts = [lines[0], *(m.start() + x for x in lines[1:])]
        sizes = [len(x) for x in re.split(r"\r?\n", m[0])]
        short = sum(c not in "\r\n=" for c in tail[0])
        left, done = sum(sizes), 0
        for at, size in zip(starts, sizes):
            head = base64.b64decode(text[at : at + 16]) if at >= done else b""
            for extra in (0, short) if short else (0,):
                if head and _fits(head, left + extra):
                    end = tail.end() if extra or not short else m.end()
                    b = decode64("".join(text[at:end].split()))
                    if b and (detail := decoded(b)):
                        yield at, end, detail
                        done = end
                        break
            left -= size
    for m in HEX_RUN.finditer(text):
        if len(m[0]) % 2 == 0 and (detail := decoded(bytes.fromhex(m[0]))):
            yield m.start(), m.end(), detail


def find_spans(text: str | None) -> list[tuple[str, int, int, str | None]]:
    """(kind, start, end, detail) of all spans by start, then kind as listed."""
    if not text:
        return []
    out: list[tuple[str, int, int, str | None]] = [("assign", *m.span(), None) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    out += [("access", *m.span(), None) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span(), None) for m in HEX.finditer(text)]
    armoured = list(pems(text)) if "-----BEGIN " in text else []
    out += [("pem", *x) for x in armoured]
    starts = [x[0] for x in armoured]

    def inside(a: int) -> bool:
        k = bisect_right(starts, a) - 1
        return k >= 0 and a < armoured[k][1]

    out += [("key", *x) for x in keys(text) if not inside(x[0])]
    out += [("jwt", *x) for x in jwts(text) if not inside(x[0])]
    return sorted(out, key=lambda x: (x[1], RANK[x[0]]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``spans`` (kind, start, end, detail: what a confirmed span encodes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("detail", pa.string())]))
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "detail"), x)) for x in find_spans(t)] for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(found, kind)], ["id", "spans"])

    key = docs.schema[id_col].dataType.simpleString()
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {key}, spans {SPANS}")
    return got.select(F.col("id").alias(id_col), "spans")


def listed(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of some kinds, joined by commas."""
    mine = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(mine, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find(read(spark, sf_dir, "documents")).select(
        F.col("doc_id").cast("long").alias("doc_id"), *map(count, BASE), F.sha2(listed(spans, BASE), 256).alias("base_sha256"), listed(spans).alias("spans")
    )
