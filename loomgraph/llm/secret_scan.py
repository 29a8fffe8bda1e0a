"""Secret scans with structural confirmation.

Three pattern kinds (assign, access, hex) are reported as they match. Further candidates (dotted tokens, base64 and hex
runs, armoured blocks) are decoded and only reported if their structure holds: a signed token's header must be JSON
with an algorithm; a private key's nested ASN.1 lengths must add up and its fields be those of one of the private shapes;
an OpenSSH private key's length-prefixed fields must fill it; an encrypted block must say its cipher and hold whole blocks
of it. Signatures, certificates and public keys are no secrets and are not reported.

Scale: one pass over the texts, no shuffle. A vectorised look at the bytes of a chunk finds the texts that can match at
all; the patterns then run over those whole texts.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_BYTES, chunks, table, text_buffer

KINDS = ["assign", "access", "hex", "jwt", "pem", "der", "ssh"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: A JSON object's first bytes in base64: a brace, then a quote or white space.
JWT_STARTS = ("eyJ", "eyA", "ewo", "ew0", "ewk")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(?:eyJ|eyA|ewo|ew0|ewk)[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----\s*((?:[A-Za-z0-9-]+: [^\n]*\n)*)([A-Za-z0-9+/=\s]*)-----END \1-----")
ENCODED = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_DIGITS = re.compile(r"[0-9A-Fa-f]{64,}")
#: How base64 of a key begins: of a SEQUENCE, of the private container of OpenSSH.
ENCODED_STARTS = ("M", "b3BlbnNzaC1rZXktdjEA")
WORDS = (b"passw", b"secret", b"token", b"api")
LONG = 32


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


HEX_BYTES = _class(b"0123456789abcdef")
CODE_BYTES = _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-.=")


def der_value(data: bytes, at: int, end: int, depth: int = 0) -> tuple[int, int, int] | None:
    """(tag, start of content, end of value) of the ASN.1 value at data[at:end] if its nested lengths add up, else None."""
    if at + 2 > end or depth > 12:
        return None
    tag, size, body = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or body + n > end:
            return None
        size, body = int.from_bytes(data[body : body + n], "big"), body + n
        if size < 0x80:
            return None
    stop = body + size
    if stop > end:
        return None
    if tag & 0x20:
        inner = body
        while inner < stop:
            if (x := der_value(data, inner, stop, depth + 1)) is None:
                return None
            inner = x[2]
    return tag, body, stop


def der_fields(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The ASN.1 values that fill data[at:end], or None."""
    out = []
    while at < end:
        if (x := der_value(data, at, end)) is None:
            return None
        out.append(x)
        at = x[2]
    return out


INTEGER, OCTETS, OID, SEQUENCE, FIRST, SECOND = 0x02, 0x04, 0x06, 0x30, 0xA0, 0xA1
# The beginnings of the object identifiers of password-based encryption (PKCS #5 and #12).
PASSWORD_OIDS = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01")


def algorithm_of(data: bytes, value: tuple[int, int, int]) -> bytes | None:
    """The object identifier that a SEQUENCE begins with."""
    fields = der_fields(data, value[1], value[2]) if value[0] == SEQUENCE else None
    return data[fields[0][1] : fields[0][2]] if fields and fields[0][0] == OID and fields[0][2] - fields[0][1] >= 3 else None


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE that fills data and has the fields of a private key: PKCS #8 plain or encrypted, RSA, DSA, or SEC 1."""
    top = der_value(data, 0, len(data))
    if top is None or top[0] != SEQUENCE or top[2] != len(data) or top[2] - top[1] < 16:
        return False
    fields = der_fields(data, top[1], top[2]) or []
    tags = [f[0] for f in fields]
    if tags[:2] == [SEQUENCE, OCTETS] and len(tags) == 2:
        return (algorithm_of(data, fields[0]) or b"").startswith(PASSWORD_OIDS)
    version = data[fields[0][1] : fields[0][2]] if tags[:1] == [INTEGER] else b""
    if version not in (b"\0", b"\1"):
        return False
    if tags[1:3] == [SEQUENCE, OCTETS]:  # PKCS #8: attributes and a public key may follow
        return algorithm_of(data, fields[1]) is not None and all(t in (FIRST, SECOND, 0x81) for t in tags[3:])
    if tags[1:2] == [OCTETS]:  # SEC 1: the scalar, then curve and public key
        return version == b"\1" and 16 <= fields[1][2] - fields[1][1] <= 72 and all(t in (FIRST, SECOND) for t in tags[2:])
    whole = all(t == INTEGER for t in tags[:9]) and all(f[2] > f[1] for f in fields)
    if version == b"\0" and whole and len(tags) == 6:  # DSA: p, q, g, y, x
        return fields[1][2] - fields[1][1] >= 64
    return whole and (len(tags) == 9 or len(tags) == 10 and version == b"\1" and tags[9] == SEQUENCE)


def ssh_field(data: bytes, at: int) -> tuple[bytes, int] | None:
    """(a length-prefixed field at a place, where it ends), or None."""
    n = int.from_bytes(data[at : at + 4], "big")
    return (data[at + 4 : at + 4 + n], at + 4 + n) if at + 4 + n <= len(data) else None


def is_ssh_key(data: bytes) -> bool:
    """OpenSSH's private container: cipher, key derivation, its options, number of keys, public keys, the private part."""
    magic = b"openssh-key-v1\0"
    at = len(magic)
    if not data.startswith(magic):
        return False
    names = []
    for _ in range(3):
        if (x := ssh_field(data, at)) is None:
            return False
        names.append(x[0])
        at = x[1]
    keys = int.from_bytes(data[at : at + 4], "big")
    if not all(re.fullmatch(rb"[a-z0-9@.-]+", n) for n in names[:2]) or not 1 <= keys <= 64:
        return False
    at += 4
    for _ in range(keys):
        public = ssh_field(data, at)
        if public is None or (name := ssh_field(public[0], 0)) is None or not re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", name[0]):
            return False
        at = public[1]
    private = ssh_field(data, at)
    return private is not None and private[1] == len(data) and len(private[0]) > 8 and len(private[0]) % 8 == 0


def is_encrypted_block(headers: str, raw: bytes) -> bool:
    """The headers of an encrypted PEM block name a cipher and its start, and the block is whole for that cipher."""
    m = re.search(r"^DEK-Info: *[A-Za-z0-9-]+,([0-9A-Fa-f]+)\s*$", headers, re.M)
    return bool(m) and "ENCRYPTED" in headers and len(m[1]) in (16, 32) and len(raw) >= 16 and len(raw) % (len(m[1]) // 2) == 0


def unbase64(s: str) -> bytes | None:
    s = re.sub(r"\s", "", s).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(s: str) -> bool:
    raw = unbase64(s.split(".")[0])
    try:
        head = json.loads(raw) if raw else None
    except ValueError:
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def scan_text(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of all spans, sorted; code points, end exclusive."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LONG]
    out += [(m.start(), 3, m.end()) for m in JWT.finditer(text) if is_signed_token(m[0])]
    keys = lambda raw: [k for k, ok in ((5, is_der_key), (6, is_ssh_key)) if ok(raw)]
    blocks = []
    for m in PEM.finditer(text):
        raw = unbase64(m[3])
        if raw and (is_encrypted_block(m[2], raw) if m[2] else keys(raw)):
            out.append((m.start(), 4, m.end()))
            blocks.append(m.span())
    blocks = iter([*blocks, (len(text) + 1, 0)])
    begin, end = next(blocks)
    for m in ENCODED.finditer(text):
        while end and m.start() >= end:
            begin, end = next(blocks)
        if m.start() < begin and m[0].startswith(ENCODED_STARTS) and (raw := unbase64(m[0])):
            out += [(m.start(), k, m.end()) for k in keys(raw)]
    for m in HEX_DIGITS.finditer(text):
        if len(m[0]) % 2 == 0 and m[0].startswith(("30", "6f70656e7373682d", "6F70656E7373682D")):
            out += [(m.start(), k, m.end()) for k in keys(bytes.fromhex(m[0]))]
    return sorted(set(out))


def candidates(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Indexes of the texts in which a pattern can match."""
    at = [np.zeros(0, np.int64)]
    raw, low = data.tobytes(), LOWER_BYTES[data].tobytes()
    for where, words in ((low, WORDS), (raw, (b"AKIA", b"-----BEGIN ", *(x.encode() for x in JWT_STARTS)))):
        for word in words:
            found, k = [], where.find(word)
            while k >= 0:
                found.append(k)
                # the rest of this text needs no look
                nxt = offsets[np.searchsorted(offsets, k, side="right")]
                k = where.find(word, int(nxt) - len(word) + 1 if nxt - len(word) + 1 > k else k + 1)
            at.append(np.array(found, dtype=np.int64))
    for kind in (HEX_BYTES, CODE_BYTES):
        gap = np.concatenate([[-1], np.flatnonzero(~kind[data]), [len(data)]])
        at.append(gap[:-1][np.diff(gap) > LONG] + LONG)
    hits = np.concatenate(at)
    return np.unique(np.searchsorted(offsets, hits, side="right") - 1)


#: A long run of code characters in the joined bytes may span texts: every text that it touches is looked at.
def touched(data: np.ndarray, offsets: np.ndarray) -> set[int]:
    out = set(candidates(data, offsets).tolist())
    gap = np.concatenate([[-1], np.flatnonzero(~CODE_BYTES[data]), [len(data)]])
    wide = np.diff(gap) > LONG
    for a, b in zip(gap[:-1][wide] + 1, gap[1:][wide]):
        out.update(range(int(np.searchsorted(offsets, a, side="right")) - 1, int(np.searchsorted(offsets, b, side="left"))))
    return {k for k in out if 0 <= k < len(offsets) - 1}


SCHEMA = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches, "text"):
        data, offsets = text_buffer(b.column("text"))
        found: list[list[dict]] = [[] for _ in range(b.num_rows)]
        for k in touched(data, offsets):
            text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
            found[k] = [{"kind": KINDS[r], "start": s, "end": e} for s, r, e in scan_text(text)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(found, type=SCHEMA.field("spans").type)], schema=SCHEMA)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> (by start, then kind as in KINDS) for each row of docs (doc_id, text).

    Null and empty texts have no spans; null ids and repeated rows are kept; other columns are left out. Texts are scanned
    whole, however long; an empty table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_scan, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
