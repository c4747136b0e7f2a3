"""Secret scans with structural confirmation.

Base patterns (assignments, access keys, hexadecimal runs) are reported as they match. Beyond
them, runs of base64, base64url or hexadecimal digits are candidates: each is
decoded, and it is reported only if its bytes have the structure of a credential:
DER keys (nested lengths that fill the whole), OpenSSH private and public keys (length-prefixed
fields), PEM blocks whose body confirms, and signed tokens (a JSON header with an
algorithm, a JSON claim set and a signature of the length that the algorithm makes).

Base64 that is wrapped into lines of one width is joined before it is decoded, with or without a PEM head, and with the same indent or mark of
quotation or comment before every line. Where a run as a whole is no key, its parts after a slash, dash or underscore are tried that begin as keys
do: a path or a name may stand before one.

Runs as a map over Arrow batches: whole texts, no shuffle, one text at a time in memory. Each
pattern starts only where a run begins and never goes back over it, the marks of PEM blocks are paired in one pass, and
each body is decoded once, so a scan is linear in the text.

Defined results: null text is empty text; no match gives zeros, the digest of the empty string and an
empty span list; a header, claim set or length that isn't of the kind it should be is no secret; an empty table gives an empty
result; repeated rows each get a result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in their order at equal starts: base kinds, then those of the structural method.
KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "openssh", "sshkey")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEXRUN = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
PEM = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{3,40})-----")
BODY = re.compile(r"(?:[A-Za-z0-9+/=\s:,.>#*|-]|\\[nr])*+")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+={0,2}")
#: Lines of nothing but base64, after what may stand before every line.
LEAD = r"[ \t]*+(?:(?:[>#*|]|//(?=[ \t]))[ \t]*+)*+"
LINE = re.compile(rf"^({LEAD})([A-Za-z0-9+/]++={{0,2}})(?=\r?$)", re.M)
#: Where a key may begin within a run: the first digits of DER, OpenSSH and SSH keys.
WITHIN = re.compile(r"(?<=[/_-])(?=M[A-Z]|b3BlbnNzaC1rZXktdjE|AAAA)")
HEXKEY = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}+")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+)")
#: Least length of a wrapped key's lines but the last.
WRAP = 40
#: Bytes of signature by algorithm; 0: any that isn't empty.
SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64, "RS256": 0, "RS384": 0, "RS512": 0, "PS256": 0, "PS384": 0, "PS512": 0}


def decoded(s: str) -> bytes | None:
    """Bytes of base64 or base64url, padded or not."""
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der(data: bytes, start: int = 0) -> bool:
    """A SEQUENCE that fills the data from `start` on and holds an INTEGER and one more element at least, every length of it nested rightly."""

    def elements(at: int, end: int, depth: int) -> list[int] | None:
        tags = []
        while at < end:
            if end - at < 2:
                return None
            tag, n = data[at], data[at + 1]
            at += 2
            if n & 0x80:
                k = n & 0x7F
                if not 1 <= k <= 4 or end - at < k:
                    return None
                n = int.from_bytes(data[at : at + k], "big")
                at += k
                if n < 0x80:
                    return None
            if n > end - at or tag == 0:
                return None
            if tag & 0x20 and (depth > 8 or elements(at, at + n, depth + 1) is None):
                return None
            if tag == 2 and n == 0:
                return None
            tags.append(tag)
            at += n
        return tags

    if len(data) - start < 24 or data[start] != 0x30:
        return False
    head = start + 2 + (data[start + 1] & 0x7F if data[start + 1] & 0x80 else 0)
    whole = data[start + 1] if head == start + 2 else int.from_bytes(data[start + 2 : head], "big")
    if head + whole != len(data) or elements(start, len(data), 0) != [0x30]:
        return False
    inner = elements(head, len(data), 1)
    # Private keys begin with a version; public keys are an algorithm and a bit string.
    return inner is not None and ((len(inner) >= 2 and inner[0] == 2) or inner == [0x30, 0x03])


def fields(data: bytes, at: int, n: int) -> int | None:
    """Where n length-prefixed fields end."""
    for _ in range(n):
        if len(data) - at < 4:
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        if at > len(data):
            return None
    return at


def openssh(data: bytes, start: int = 0) -> bool:
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic, start):
        return False
    at = fields(data, start + len(magic), 3)  # cipher, key derivation, its options
    if at is None or len(data) - at < 4:
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    return 1 <= keys <= 16 and fields(data, at + 4, keys + 1) == len(data)


def sshkey(data: bytes, start: int = 0) -> bool:
    """A name and up to eight fields that fill the data; no kind of key has more."""
    n = int.from_bytes(data[start : start + 4], "big")
    if not 7 <= n <= 64 or not re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]+", data[start + 4 : start + 4 + n]):
        return False
    at, count = start + 4 + n, 0
    while at is not None and at < len(data) and count < 8:
        at, count = fields(data, at, 1), count + 1
    return at == len(data) and count >= 1


def blob(data: bytes | None, start: int = 0) -> str | None:
    """The kind of key that these bytes are from `start` on."""
    if not data:
        return None
    return "der" if der(data, start) else "openssh" if openssh(data, start) else "sshkey" if sshkey(data, start) else None


def within(run: str) -> tuple[int, str] | None:
    """(place, kind) of the first part of a base64 run that is a key up to the run's end. Each of the four alignments is decoded once."""
    s = run.rstrip("=").replace("-", "+").replace("_", "/")
    data: dict[int, bytes | None] = {}
    for m in WITHIN.finditer(run):
        at = m.start()
        if (len(s) - at) % 4 == 1 or at >= len(s):
            continue
        shift = at % 4
        if shift not in data:
            data[shift] = decoded(s[shift:])
        if (whole := data[shift]) is not None and (kind := blob(whole, (at - shift) // 4 * 3)):
            return at, kind
    return None


def token(header: str, claims: str, signature: str) -> bool:
    try:
        h, c = (json.loads(decoded(x) or b"") for x in (header, claims))
    except (ValueError, RecursionError):
        return False
    if not isinstance(h, dict) or not isinstance(c, dict) or not isinstance(h.get("alg"), str) or h["alg"] not in SIGNATURE:
        return False
    got = decoded(signature)
    return bool(got) and SIGNATURE[h["alg"]] in (0, len(got))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Base matches; a group that is too short is consumed and dropped."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return out + [(m.start(), m.end(), "hex") for m in HEXRUN.finditer(text)]


def pem_blocks(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, label, body) of each end mark and the begin mark of the same label right before it."""
    begun = None
    for m in PEM.finditer(text):
        if m[1] == "BEGIN":
            begun = m
            continue
        if begun and begun[2] == m[2] and BODY.fullmatch(text, begun.end(), m.start()):
            yield begun.start(), m.end(), m[2], text[begun.end() : m.start()]
        begun = None


def wrapped(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, joined) of runs of base64 lines: all as wide as the first, but for the last, which may be shorter."""
    run: list[re.Match] = []

    def whole() -> Iterator[tuple[int, int, str]]:
        if len(run) > 1:
            yield run[0].start(2), run[-1].end(), "".join(x[2] for x in run)
        run.clear()

    for m in LINE.finditer(text):
        width = len(m[2])
        if run and (text[run[-1].end() : m.start()] not in ("\n", "\r\n") or width > len(run[0][2]) or m[1] != run[0][1]):
            yield from whole()
        if run or width >= WRAP:
            run.append(m)
            if width < len(run[0][2]) or m[2].endswith("="):
                yield from whole()
    yield from whole()


def more_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans that structure confirms. Blocks, wrapped keys and tokens are not reported again as what they hold."""
    out = []
    if "-----BEGIN " in text:
        for a, b, label, body in pem_blocks(text):
            body = re.sub(rf"(?m)^{LEAD}", "", body.replace("\\n", "\n").replace("\\r", ""))
            body = re.sub(r"(?m)^[A-Za-z-]+:.*$|\s+", "", body)
            if blob(decoded(body)) or ("ENCRYPTED" in label and decoded(body)):
                out.append((a, b, "pem"))
    if "eyJ" in text:
        out += [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if token(*m.groups())]
    if "\n" in text:
        pems = sorted(out)
        out += [(a, b, kind) for a, b, joined in wrapped(text) if not held(pems, a) and (kind := blob(decoded(joined)))]
    taken = sorted(out)
    for pattern, decode in ((BASE64, decoded), (HEXKEY, lambda s: bytes.fromhex(s) if len(s) % 2 == 0 else None)):
        for m in pattern.finditer(text):
            if held(taken, m.start()):
                continue
            if kind := blob(decode(m[0])):
                out.append((m.start(), m.end(), kind))
            elif pattern is BASE64 and (part := within(m[0])):
                out.append((m.start() + part[0], m.end(), part[1]))
    return out


def held(spans: list[tuple[int, int, str]], at: int) -> bool:
    """Whether the last of these sorted spans to begin at or before `at` goes beyond it."""
    i = bisect_right(spans, at, key=lambda x: x[0])
    return i > 0 and at < spans[i - 1][1]


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed); offsets are code points, end exclusive."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = more_spans(text)
                for i, k in enumerate(KINDS[:3]):
                    cols[i].append(sum(x[2] == k for x in base))
                cols[3].append(hashlib.sha256(listed(base).encode()).hexdigest())
                cols[4].append(listed(base + more))
                cols[5].append(len(more))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], *[pa.array(c, pa.string()) for c in cols[3:5]], pa.array(cols[5], pa.int64())], names)

    names = [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"]
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")
