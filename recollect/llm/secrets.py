"""Secret scan: patterns propose, decoding confirms.

Three base patterns report by their own form. Beside them, runs that could be encoded material (base64, base64url, hex,
PEM blocks, dotted tokens) are decoded and reported only if what they decode to has the structure of a secret: nested DER
lengths that add up, length-prefixed SSH key fields that fill the blob, a signed token's JSON header that names its
algorithm, or text (UTF-8 or UTF-16) that holds a base secret itself or, encoded once more, up to three times, one of these. Armoured OpenPGP keys
are reported if they begin with the packet of a secret key and their checksum holds; those without a checksum line are not.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ["assign", "access", "hex"]
KINDS = [*BASE_KINDS, "token", "key", "encoded"]
SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"

_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]*)*")
_BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}KEY[A-Z0-9 ]{0,20})-----((?:[A-Za-z0-9+/=\s\\:,]|-(?!----))*+)-----END \1-----")
_ARMOUR = re.compile(r"-----BEGIN PGP PRIVATE KEY BLOCK-----\s*(?:[A-Za-z]+: [^\n]*\n)*\s*([A-Za-z0-9+/\s]++={0,2}\s*)=([A-Za-z0-9+/]{4})\s*-----END PGP PRIVATE KEY BLOCK-----")
_ENCRYPTED = re.compile(r"(?:\s|\\[nr])*Proc-Type:\s*4,ENCRYPTED(?:\s|\\[nr])+DEK-Info:\s*[A-Z0-9-]+,[0-9A-Fa-f]{16,}(?:\s|\\[nr])+")
# the shortest base secret, token=abcdef, has 12 bytes: 16 letters in base64, 24 in hex
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{24,}")


#: PKCS#5 and PKCS#12 object identifiers in DER.
_SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns' matches, kind by kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def decoded(run: str) -> bytes | None:
    """A run of base64 in either alphabet, padded or not; None if its length or letters allow no decoding."""
    body = re.sub(r"\\[nr]|[\s\\]", "", run).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """(tag, content) of each item if lengths, nested ones too, add up to the whole; else None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            n = int.from_bytes(data[at : at + width])
            at += width
        if at + n > len(data):
            return None
        content = data[at : at + n]
        if tag & 0x20 and depth < 12 and der_items(content, depth + 1) is None:
            return None
        items.append((tag, content))
        at += n
    return items


def is_key(data: bytes) -> bool:
    """Whether bytes are a private key: PKCS#1, PKCS#8 (plain or encrypted) or SEC1 in DER, or an OpenSSH key."""
    if data.startswith(b"openssh-key-v1\0"):
        at = 15
        for _ in range(3):
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4])
        return at + 4 <= len(data) and int.from_bytes(data[at : at + 4]) >= 1
    if data[:1] != b"\x30" or len(data) < 32:
        return False
    outer = der_items(data)
    if not outer or len(outer) != 1:
        return False
    parts = der_items(outer[0][1]) or []
    tags = [t for t, _ in parts]
    if tags == [0x30, 0x04]:  # PKCS#8, encrypted: the name of a password-based scheme, then the bytes
        scheme = der_items(parts[0][1]) or [(0, b"")]
        return scheme[0][0] == 0x06 and scheme[0][1].startswith(_SCHEMES)
    if tags[:1] != [0x02] or parts[0][1] not in (b"\0", b"\1"):
        return False
    # nine numbers of an RSA key, six of a DSA key (version, p, q, g, public, private)
    numbers = (len(tags) >= 9 or len(tags) == 6) and all(t == 0x02 for t in tags[:9])
    wrapped = tags[1:3] == [0x30, 0x04] and (der_items(parts[1][1]) or [(0, b"")])[0][0] == 0x06
    curve = tags[1:2] == [0x04] and len(parts[1][1]) in (28, 32, 48, 66)
    return numbers or wrapped or curve


def is_token(text: str) -> bool:
    """Whether dotted base64url parts begin with a JSON header that names an algorithm, and carry a JSON body or ciphertext."""
    parts = text.split(".")
    header = decoded(parts[0])
    if len(parts) not in (3, 5) or header is None or (not parts[1] and len(parts) == 3):
        return False
    try:
        head = json.loads(header)
    except ValueError:
        return False
    if not isinstance(head, dict) or not isinstance(head.get("alg"), str):
        return False
    if len(parts) == 5:
        return "enc" in head
    body = decoded(parts[1])
    return body is not None and body[:1] == b"{" and body.rstrip()[-1:] == b"}" and bool(parts[2] or head["alg"] == "none")


def token_length(text: str) -> int:
    """The length of the signed or encrypted token that a match of _TOKEN begins with, 0 if there is none: what follows its last part may be a full stop or the next sentence."""
    parts = text.split(".")
    for n in (len(parts), 5, 3):
        token = ".".join(parts[:n])
        if n <= len(parts) and is_token(token):
            return len(token)
    return 0


def as_text(data: bytes) -> str | None:
    """Bytes as printable text: UTF-8, or UTF-16 in either order where every other byte of its ASCII part is 0; else None."""
    order = "utf-16-le" if data[:2] == b"\xff\xfe" or data[1:8:2] == b"\0\0\0\0"[: len(data[1:8:2])] else "utf-16-be" if data[:2] == b"\xfe\xff" or data[0:8:2] == b"\0\0\0\0"[: len(data[0:8:2])] else "utf-8"
    try:
        text = data.decode(order).removeprefix("\ufeff")
    except UnicodeDecodeError:
        return None
    return text if all(c.isprintable() or c in "\r\n\t" for c in text) else None


def holds_secret(data: bytes, depth: int = 0) -> bool:
    """Whether bytes are printable text with a base secret or a signed token, or with encoded text (up to DEPTH times) that holds one."""
    text = as_text(data)
    if text is None:
        return False
    if base_spans(text) or any(token_length(m[0]) for m in _TOKEN.finditer(text)):
        return True
    return depth < DEPTH and any(secret_kind(inner, depth + 1) for pattern, decode in DECODERS for m in pattern.finditer(text) for inner in decode(m[0]))


def secret_kind(data: bytes | None, depth: int = 0) -> str | None:
    """What decoded bytes are: a key, text that holds a secret, or neither."""
    return None if not data else "key" if is_key(data) else "encoded" if holds_secret(data, depth) else None


def is_block(body: str) -> bool:
    """Whether what stands between the lines of a PEM block is a private key, or one encrypted under headers that say how."""
    head = _ENCRYPTED.match(body)
    if head:
        data = decoded(body[head.end() :])
        return bool(data) and len(data) % 8 == 0
    return is_key(decoded(body) or b"")


def is_armour(body: str, checksum: str) -> bool:
    """Whether the lines of an armoured block decode to packets of a secret key (tag 5 or 7) whose checksum is the one given."""
    data = decoded(body)
    if not data or not data[0] & 0x80 or (data[0] & 0x3F if data[0] & 0x40 else data[0] >> 2 & 0xF) not in (5, 7):
        return False
    crc = 0xB704CE
    for byte in data:
        crc ^= byte << 16
        for _ in range(8):
            crc = (crc << 1) ^ (0x1864CFB if crc & 0x800000 else 0)
    return (decoded(checksum) or b"") == crc.to_bytes(3)


def from_hex(run: str) -> list[bytes]:
    """What a run of hex digits may stand for; one of odd length without its last or its first digit."""
    return [bytes.fromhex(x) for x in ([run[:-1], run[1:]] if len(run) % 2 else [run])]


#: How often text found by decoding is decoded again. A run of n letters costs n * (1 + 3/4 + ...) at most.
DEPTH = 3
DECODERS = [(_RUN, lambda x: [decoded(x)]), (_HEX_RUN, from_hex)]


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of encoded candidates whose decoded structure is a secret's."""
    out = []
    if "eyJ" in text:
        out += [("token", m.start(), m.start() + n) for m in _TOKEN.finditer(text) if (n := token_length(m[0]))]
    if "-----BEGIN" in text:
        out += [("key", m.start(), m.end()) for m in _BLOCK.finditer(text) if is_block(m[2])]
        out += [("key", m.start(), m.end()) for m in _ARMOUR.finditer(text) if is_armour(m[1], m[2])]
    for pattern, decode in DECODERS:
        taken, at, added = sorted((s, e) for _, s, e in out), 0, []
        for m in pattern.finditer(text):  # both are in order, so one place moves along
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            if at < len(taken) and taken[at][0] < m.end():
                continue
            for data in decode(m[0]):
                if kind := secret_kind(data):
                    added.append((kind, m.start(), m.end()))
                    break
        out += added
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id and spans (kind, start, end in code points, end exclusive) by start, then kind as listed in KINDS.

    A null or empty text has no spans; a null doc_id stays null; repeated rows are scanned one by one; no rows give none.
    Other columns are dropped. Long texts are scanned whole, in time proportional to their length.
    """
    order = {k: i for i, k in enumerate(KINDS)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = []
            for text in batch.column(1):
                text = text.as_py() or ""
                spans = sorted(base_spans(text) + confirmed_spans(text), key=lambda x: (x[1], order[x[0]]))
                found.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, SCHEMA)
