"""Secret scans that confirm structure before they report.

A candidate is found by its looks and reported only if decoding bears it out:

* ``private_key``, ``public_key``, ``certificate``: base64 or hex whose DER is a SEQUENCE with nested lengths
  that fill exactly, at every depth, of the shape the kind has. Base64 is in PEM armour or bare; both it and
  hex may be wrapped: lines follow each other while they are as long as the first. The outermost length says
  where a bare key ends. A PEM key that is encrypted the old way has its cipher's IV and whole blocks instead.
* ``ssh_key``: base64 or hex of length-prefixed fields that begin with a key type or the OpenSSH magic.
* ``jwt``: three base64url parts; the header is a JSON object with an ``alg``, the payload a JSON object.
* ``access_key_id``: AKIA or ASIA and 16 base32 characters, which decode to a key id of 10 bytes.
* ``github_token``: a prefix, 30 characters and the CRC-32 of them in base 62.
* ``hex_secret`` and ``base64_secret``: a value assigned to a name such as token, secret, key or
  password that decodes to a whole number of bytes, of one of the lengths keys have (hex; 8 or more
  for a password) or at least 16 bytes (base64), with as many different bytes as chance gives.

``digest`` is the SHA-256 of the secret, so that a report doesn't spread it.

Defined cases: rows with a null id or text and texts without a candidate give no row; repeated
rows are reported each; overlapping candidates are reported once, by the first kind in the order
above; texts are scanned whole, in time linear in their length and findings; ids are numbers or cast to
them; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrine.llm.kernel import blocks, text_array
from vectrine.llm.shared import own, prepare

RESULT = "doc_id bigint, kind string, start int, length int, detail string, digest string"
#: What any candidate has: cheap for the whole corpus, before the patterns below look closer.
LIKELY = r"[0-9A-Fa-f]{32}|(?:[0-9A-Fa-f]{2}[: ]){15}|[A-Za-z0-9+/_\-]{36}|A[KS]IA[A-Z0-9]{16}|-----BEGIN |eyJ[\w\-]+\.|(?i:token|secret|passw|key|auth|credential)\w*[\"']?\s*[:=]"
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{3,40})-----((?:\s*[A-Za-z][A-Za-z\-]*: [^\r\n]*)*)([A-Za-z0-9+/=\s\\]+)-----END \1-----")
DEK = re.compile(r"DEK-Info: (\w+)-[\w\-]+,([0-9A-F]+)")
JWT = re.compile(r"(?<![\w\-.])(eyJ[\w\-]+)\.([\w\-]+)\.([\w\-]*)(?![\w\-])")
AKIA = re.compile(r"(?<![A-Za-z0-9])A[KS]IA([A-Z0-9]{16})(?![A-Za-z0-9])")
GITHUB = re.compile(r"(?<![A-Za-z0-9_])(gh[pousr]_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
#: First lines of what may be a key, and a line that goes on.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/])(?=M[A-P]|AAAA|b3BlbnNzaC1rZXk)[A-Za-z0-9+/]{40,}={0,2}(?![A-Za-z0-9+/=])")
MORE64 = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/]+={0,2})(?![A-Za-z0-9+/=])")
BASE16 = re.compile(r"(?i)(?<![0-9A-Za-z])(?=30|0000000b7373682d|000000077373682d|000000136563|6f70656e7373682d|00[: ]00[: ]00|6f[: ]70[: ]65)(?:[0-9a-f]{2}[: ]?+){15,}+")
MORE16 = re.compile(r"(?i)\r?\n[ \t]*((?:[0-9a-f]{2}[: ]?+)++)")
NAMED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|passwd|key|auth|credential)[\w\-]{0,64}[\"']?\s{0,8}[:=]{1,2}>?\s{0,8}(?:bearer\s{1,8})?([\"']?)([A-Za-z0-9+/_\-]{16,}={0,2})\1")
HEX = re.compile(r"[0-9a-fA-F]+\Z")
HEX_BYTES = frozenset((16, 20, 24, 28, 32, 48, 64))
SSH = re.compile(rb"ssh-(?:rsa|dss|ed25519)|ecdsa-sha2-nistp\d+|sk-(?:ssh|ecdsa)[\w\-@.]+")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def decode64(text: str, url: bool = False) -> bytes | None:
    text = re.sub(r"\\n|\s", "", text).rstrip("=")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes) -> list | None:
    """(tag, parts, size) of a DER value's parts, nested; None unless every length fits exactly, however deep."""
    root: list = []
    stack, at = [(root, len(data))], 0
    while True:
        while at == stack[-1][1]:
            if len(stack) == 1:
                return root
            stack.pop()
        parts, end = stack[-1]
        if (head := der_head(data, at, end)) is None:
            return None
        tag, at, size = head
        parts.append((tag, [] if tag & 32 else None, size))
        if tag & 32:
            stack.append((parts[-1][1], at + size))
        else:
            at += size


def der_head(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, where its content begins, size) of the value at ``at``, which must be over by ``end``."""
    if at + 2 > end:
        return None
    tag, size = data[at], data[at + 1]
    at += 2
    if tag & 31 == 31 or tag == 0:
        return None
    if size & 128:
        n = size & 127
        if not 1 <= n <= 4 or at + n > end or data[at] == 0:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        at += n
        if size < 128:
            return None
    return (tag, at, size) if at + size <= end else None


def key_kind(data: bytes) -> tuple[str, str] | None:
    """(kind, what it holds) of decoded bytes, if they are a key or certificate."""
    if data[:15] == b"openssh-key-v1\0":
        return ("ssh_key", "openssh private") if ssh_fields(data[15:], 3) else None
    if len(data) > 8 and SSH.match(data[4:60]):
        return ("ssh_key", SSH.match(data[4:60])[0].decode()) if ssh_fields(data, 2) else None
    if len(data) < 16 or data[0] != 0x30 or not (top := der(data)) or len(top) != 1:
        return None
    parts = top[0][1] or []
    tags = [p[0] for p in parts]
    if len(tags) >= 9 and set(tags[:9]) == {2}:
        return "private_key", f"rsa, {8 * (parts[1][2] - parts[1][2] % 8)} bits"
    if tags[:2] == [2, 4] and len(data) < 400:
        return "private_key", "elliptic curve"
    if tags[:3] == [2, 0x30, 4]:
        return "private_key", "pkcs8"
    if tags == [0x30, 4] and parts[0][1] and parts[0][1][0][0] == 6:
        return "private_key", "encrypted pkcs8"
    if tags == [0x30, 3] and parts[0][1] and parts[0][1][0][0] == 6:
        return "public_key", "subject public key"
    if tags == [0x30, 0x30, 3] and len(parts[0][1] or ()) >= 6:
        return "certificate", "x509"
    if len(tags) in (2, 6) and set(tags) == {2} and parts[0][2] > 1 + (len(tags) == 6) * -1:
        return ("public_key", "rsa") if len(tags) == 2 and parts[0][2] >= 64 else ("private_key", "dsa") if len(tags) == 6 else None
    return None


def ssh_fields(data: bytes, least: int) -> bool:
    """Length-prefixed fields, at least so many, that do not overrun."""
    at = n = 0
    while at + 4 <= len(data) and n < least:
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        n += 1
    return n >= least and at <= len(data)


def varied(data: bytes) -> bool:
    """At least three quarters as many different bytes as so many random ones have."""
    n = len(data)
    return len(set(data)) >= 0.75 * 256 * (1 - (255 / 256) ** n)


def findings(text: str) -> list[tuple[str, int, int, str, str]]:
    """(kind, start, length, detail, secret) in order of place."""
    taken: list[tuple[int, int, str, str]] = []
    for confirmed in (_armoured, _tokens, _key_ids, _github, _keys, _named):
        starts, end, new = [t[0] for t in taken], 0, []
        for kind, a, b, detail in confirmed(text):
            k = bisect_left(starts, b)  # the last one taken that begins before b; those before it end before it begins
            if a >= end and (not k or taken[k - 1][1] <= a):
                new.append((a, b, kind, detail))
                end = b
        taken = sorted(taken + new)
    return [(kind, a, b - a, detail, text[a:b]) for a, b, kind, detail in taken]


Found = Iterator[tuple[str, int, int, str]]


def _armoured(text: str) -> Found:
    for m in PEM.finditer(text) if "-----BEGIN " in text else ():
        data = decode64(m[3])
        if data and (k := key_kind(data)):
            yield k[0], m.start(), m.end(), f"pem {m[1].lower()}: {k[1]}"
        elif data and (dek := DEK.search(m[2])):
            block = len(dek[2]) // 2
            if block == (16 if dek[1] in ("AES", "CAMELLIA") else 8) and len(data) >= 48 and len(data) % block == 0:
                yield "private_key", m.start(), m.end(), f"pem {m[1].lower()}: encrypted"


def _tokens(text: str) -> Found:
    for m in JWT.finditer(text) if "eyJ" in text else ():
        try:
            head, body = (json.loads(decode64(m[i], True) or b"") for i in (1, 2))
        except (ValueError, RecursionError):
            continue
        if isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict) and (m[3] or head["alg"].lower() == "none"):
            yield "jwt", m.start(), m.end(), f"alg {head['alg'][:20]}"


def _key_ids(text: str) -> Found:
    for m in AKIA.finditer(text):
        try:
            data = base64.b32decode(m[1])
        except binascii.Error:
            continue
        yield "access_key_id", m.start(), m.end(), f"account {int.from_bytes(data[:6], 'big') >> 7 & (1 << 40) - 1:012d}"


def _github(text: str) -> Found:
    for m in GITHUB.finditer(text):
        crc, code = zlib.crc32(m[2].encode()), ""
        for _ in range(6):
            crc, r = divmod(crc, 62)
            code = BASE62[r] + code
        if code == m[3]:
            yield "github_token", m.start(), m.end(), m[1]


def _keys(text: str) -> Found:
    """Bare keys, in base64 or hex, on one line or wrapped: lines as long as the first, and one shorter at the end."""
    found = []
    for name, first, more, gap, per, decode in (("base64", BASE64, MORE64, r"\s", 4 / 3, decode64), ("hex", BASE16, MORE16, r"[:\s]", 2, decode16)):
        plain = lambda line: re.sub(gap, "", line)
        at = 0
        while m := first.search(text, at):
            at = m.end()
            lines = [m[0].rstrip(": ")]
            width, have, last = len(lines[0]), len(plain(lines[0])), m.start() + len(lines[0])
            size = wanted(decode(plain(lines[0])[:24]) or b"")
            need = math.ceil(size * per) if size else None
            if need and need > len(text) - m.start():
                continue
            if need and have > need:  # what follows may look like more of it
                cut = next((k.start() for n, k in enumerate(re.finditer(r"[^: ]", lines[0])) if n == need), 0)
                if lines[0][cut - 1] in ": ":
                    lines, last = [lines[0][:cut]], m.start() + len(lines[0][:cut].rstrip(": "))
            while (need is None or have < need) and len(lines[-1]) == width and (n := more.match(text, at)):
                part = n[1].rstrip(": ")
                if len(part) > width:
                    break
                lines.append(part)
                have += len(plain(part))
                last, at = n.start(1) + len(part), n.end()
            for count in dict.fromkeys((len(lines), 1 if need is None else len(lines))):
                if (data := decode(plain("".join(lines[:count])))) and (k := key_kind(data)):
                    found.append((k[0], m.start(), last if count == len(lines) else m.start() + width, f"{name}: {k[1]}"))
                    break
            else:
                at = m.end()
    yield from sorted(found, key=lambda f: f[1])


def wanted(head: bytes) -> int | None:
    """Bytes of a whole DER value that begins so; None where it isn't one."""
    if len(head) < 6 or head[0] != 0x30:
        return None
    got = der_head(head[:6], 0, 1 << 62)
    return got[1] + got[2] if got else None


def decode16(text: str) -> bytes | None:
    return bytes.fromhex(text) if len(text) % 2 == 0 else None


def _named(text: str) -> Found:
    for m in NAMED.finditer(text):
        s = m[2]
        if HEX.match(s):
            if len(s) % 2 == 0 and (len(s) // 2 in HEX_BYTES or "passw" in m[0].lower()) and varied(data := bytes.fromhex(s)):
                yield "hex_secret", m.start(2), m.end(2), f"{len(data)} bytes"
        elif re.search(r"[0-9]", s) and re.search(r"[a-z]", s) and re.search(r"[A-Z]", s):
            data = decode64(s, url=bool(re.search(r"[-_]", s)))
            if data and len(data) >= 16 and varied(data):
                yield "base64_secret", m.start(2), m.end(2), f"{len(data)} bytes"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT: a row for each confirmed secret; start and length are in characters."""
    prepare(docs.sparkSession)

    def run(batches):
        import pyarrow.compute as pc

        for batch in batches:
            ids, text = batch.column(0), text_array(batch.column(1))
            rows: list[tuple] = []
            for i, j in blocks(text):
                part = text.slice(i, j - i)
                for k in pc.indices_nonzero(pc.match_substring_regex(part, LIKELY)).to_pylist():
                    doc = ids[i + k].as_py()
                    rows += [(doc, kind, a, n, detail, hashlib.sha256(s.encode()).hexdigest()) for kind, a, n, detail, s in findings(part[k].as_py())]
            if rows:
                cols = list(zip(*rows))
                types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "kind", "start", "length", "detail", "digest"])

    rows = own(docs, id=id_col, text=text_col).filter("id is not null and text is not null")
    return rows.select(F.col("id").cast("bigint"), "text").mapInArrow(run, RESULT)
