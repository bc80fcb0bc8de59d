"""10. Secret scan with structural confirmation.

Base patterns (assignments, access keys, hex runs) are reported as they match.
Further candidates, long base64 or hex runs, are decoded first and reported
only if their structure holds: a signed token's header and payload must be
JSON objects and the header must name an algorithm (``jwt``); a key encoding
must be nested lengths that fill each other exactly, as tag-length-value
(``der``, and ``pem`` when armoured) or as length-prefixed fields that start
with a known key type (``ssh``). Header lines of an armoured key are skipped and an
escaped line end counts as one; a key that its headers call encrypted has no
structure left but whole cipher blocks, as long as the initial vector.

Contract: spans are code points, end exclusive; a NULL or empty text has none;
texts are scanned whole, in time linear in their length; repeated rows and
rows with a NULL doc_id are kept; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import ship, slices

ship(__name__)

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "jwt", "pem", "der", "ssh")
# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
_LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----((?:[^-]|-(?!----))*+)-----END \1-----")
_CIPHER = re.compile(r"DEK-Info:[\x20\t]*[A-Z0-9-]+,[\x20\t]*((?:[0-9A-Fa-f]{16}){1,2})\s*", re.ASCII)
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_HEX_ANY = re.compile(r"(?:(?<![0-9A-Za-z])|(?<=(?<![0-9A-Za-z])0[xX]))[0-9A-Fa-f]{40,}(?![0-9A-Za-z])")
_SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-", b"sk-ssh-", b"sk-ecdsa-")
_OPENSSH = b"openssh-key-v1\x00"
_DEPTH = 16


def unbase64(run: str) -> bytes | None:
    """Standard or URL alphabet, with or without padding."""
    body = run.rstrip("=").translate({45: "+", 95: "/"})
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(part: str) -> dict | None:
    raw = unbase64(part)
    try:
        got = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def is_signed_token(run: str) -> bool:
    head, body, _ = run.split(".")
    header = _json_object(head)
    return bool(header) and isinstance(header.get("alg"), str) and _json_object(body) is not None


def _fields(raw: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag-length-value fields that fill ``raw[start:end]`` exactly."""
    out = []
    while start < end:
        if end - start < 2:
            return None
        tag, size, at = raw[start], raw[start + 1], start + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end or raw[at] == 0:
                return None
            size, at = int.from_bytes(raw[at:at + n], "big"), at + n
            if size < 0x80:
                return None
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        start = at + size
    return out


def is_der(raw: bytes) -> bool:
    """One sequence that fills ``raw``; constructed fields nest exactly; at
    least two fields, an integer or object identifier among the leaves."""
    top = _fields(raw, 0, len(raw))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    stack, leaves, fields = [(top[0], 0)], set(), 0
    while stack:
        (tag, a, b), depth = stack.pop()
        if tag & 0x20:
            inner = _fields(raw, a, b)
            if inner is None or depth >= _DEPTH:
                return False
            fields += len(inner)
            stack += [(f, depth + 1) for f in inner]
        else:
            leaves.add(tag)
    return fields >= 2 and bool(leaves & {0x02, 0x06})


def is_ssh(raw: bytes) -> bool:
    """Length-prefixed fields that fill ``raw``, the first a key type."""
    if raw.startswith(_OPENSSH):
        at, names = len(_OPENSSH), 0
        while names < 3:  # cipher, key derivation, its options
            size = int.from_bytes(raw[at:at + 4], "big")
            if at + 4 + size > len(raw):
                return False
            at, names = at + 4 + size, names + 1
        return len(raw) - at >= 4
    at, fields = 0, []
    while at < len(raw):
        size = int.from_bytes(raw[at:at + 4], "big")
        if at + 4 + size > len(raw):
            return False
        fields.append(raw[at + 4:at + 4 + size])
        at += 4 + size
    return len(fields) >= 2 and fields[0].startswith(_SSH_TYPES)


def _key_kind(raw: bytes | None) -> str | None:
    if not raw or len(raw) < 16:
        return None
    return "der" if raw[0] == 0x30 and is_der(raw) else "ssh" if is_ssh(raw) else None


def is_armoured(body: str) -> bool:
    lines = body.replace("\\r", "\n").replace("\\n", "\n").split("\n")
    raw = unbase64("".join("".join(x.split()) for x in lines if ":" not in x))
    cipher = next(filter(None, (_CIPHER.fullmatch(x.strip()) for x in lines)), None)
    if cipher:
        return bool(raw) and len(raw) >= 16 and len(raw) % (len(cipher[1]) // 2) == 0
    return bool(_key_kind(raw))


def base_spans(text: str, long_word: bool = True) -> list[tuple[int, int, str]]:
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text)
                if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)
                if m.end() - m.start() >= LEAST["access"]]
    if long_word:  # whole runs of 24 and more are the runs of the pattern that are long enough
        out += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return out


def confirmed_spans(text: str, long_word: bool = True) -> list[tuple[int, int, str]]:
    out = []
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            if is_armoured(m[2]):
                out.append((m.start(), m.end(), "pem"))
    if not long_word:
        return out
    if "eyJ" in text:
        out += [(m.start(), m.end(), "jwt") for m in _JWT.finditer(text) if is_signed_token(m[0])]
    for m in _HEX_ANY.finditer(text):
        kind = len(m[0]) % 2 == 0 and _key_kind(bytes.fromhex(m[0]))
        if kind:
            out.append((m.start(), m.end(), kind))
    for m in _BASE64.finditer(text):
        kind = _key_kind(unbase64(m[0]))
        if kind:
            out.append((m.start(), m.end(), kind))
    return out


def scan_text(text: str | None) -> tuple[list, list]:
    """Base spans and all spans, each ordered by start, then kind."""
    text = text or ""
    long_word = max(map(len, text.split()), default=0) >= LEAST["hex"]
    order = lambda s: (s[0], KINDS.index(s[2]))
    base = base_spans(text, long_word)
    return sorted(base, key=order), sorted(base + confirmed_spans(text, long_word), key=order)


def join_spans(spans: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


SCANNED = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()),
                     ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id``, base counts, digest of the base spans, all spans."""

    def kernel(batches):
        for b in slices(batches):
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                base, spans = scan_text(t)
                kinds = [s[2] for s in base]
                rows.append((d, *(kinds.count(k) for k in BASE_KINDS),
                             hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(spans)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCANNED)], schema=SCANNED)

    return docs.select("doc_id", "text").mapInArrow(
        kernel, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
