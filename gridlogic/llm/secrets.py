"""Secret scans: a keyword automaton, regular expressions anchored at its hits, then the checksums that tokens carry inside.

Kinds, in the order in which spans at the same start are listed:

    assign  (password|passwd|secret|token|api_?key), letters in either case, an optional quote, spaces, ':' or '=', spaces, an optional
            quote, then a value of 8 or more of [A-Za-z0-9+/_.=-]
    access  AKIA[A-Z0-9]+ of 16 or more characters
    hex     [0-9a-f]+ of 32 or more characters
    forge   gh[oprsu]_ or npm_ and 36 of [A-Za-z0-9], whose last six are the base-62 CRC-32 of the 30 before them
    jwt     three base64url parts, the first of which decodes to a JSON object with "alg"
    wif     51 or 52 base-58 characters from 5, K or L whose last four bytes are the double SHA-256 of the rest
    pem     a -----BEGIN ... PRIVATE KEY----- line and the next END line, of the same label, around base64 whose DER says its own length (or, in PEM's
            encrypted form, headers and whole cipher blocks; in OpenSSH's, its magic)

Each kind's matches are leftmost and do not overlap each other; a match that fails its length still takes its place. The last four kinds
count only if what is embedded in them checks out. Every kind but hex, which has no keyword, is looked for at hits of the automaton alone. Work is linear in the
text: no two hits of a kind look at the same characters again and again.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlogic.llm.common import ready, table

KINDS = ("assign", "access", "hex", "forge", "jwt", "wif", "pem")
BASE = KINDS[:3]
#: Keyword in lower case: kind. Hexadecimal runs have none and are found by their own scan.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "gho_": "forge", "ghp_": "forge", "ghr_": "forge", "ghs_": "forge", "ghu_": "forge", "npm_": "forge",
    "eyj": "jwt",
    "5h": "wif", "5j": "wif", "5k": "wif", "kw": "wif", "kx": "wif", "ky": "wif", "kz": "wif", "l1": "wif", "l2": "wif", "l3": "wif", "l4": "wif", "l5": "wif",
    "-----begin ": "pem", "-----end ": "pem",
}
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
FORGE = re.compile(rb"(?:gh[oprsu]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
JWT_RUN = re.compile(rb"[A-Za-z0-9_-]+")
WIF = re.compile(rb"(?<![0-9A-Za-z])[5KL][1-9A-HJ-NP-Za-km-z]{50,51}(?![0-9A-Za-z])")
PEM_LINE = re.compile(rb"-----(BEGIN|END) ([A-Z0-9 ]{0,40}PRIVATE KEY)-----")
PEM_HEADER = re.compile(rb"[A-Za-z0-9-]+: [^\n]*\n")
BASE58 = {c: i for i, c in enumerate(b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz")}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int) -> str:
    out = ""
    for _ in range(width):
        n, k = divmod(n, 62)
        out = BASE62[k] + out
    return out


def forge_checks(m: re.Match[bytes]) -> bool:
    return base62(zlib.crc32(m[1]), 6).encode() == m[2]


def jwt_checks(m: re.Match[bytes]) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(m[1] + b"=" * (-len(m[1]) % 4)))
    except (ValueError, TypeError, binascii.Error, RecursionError):
        return False


def wif_checks(m: re.Match[bytes]) -> bool:
    n = 0
    for c in m[0]:
        n = n * 58 + BASE58[c]
    raw = n.to_bytes(39, "big").lstrip(b"\0")
    return raw[:1] == b"\x80" and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def der_length(raw: bytes) -> int:
    """What a DER sequence says of its own length, head included; -1 if it is none."""
    if len(raw) < 2 or raw[0] != 0x30:
        return -1
    if raw[1] < 0x80:
        return 2 + raw[1]
    n = raw[1] & 0x7F
    return 2 + n + int.from_bytes(raw[2 : 2 + n], "big") if 1 <= n <= 8 else -1


def pem_checks(label: bytes, body: bytes) -> bool:
    encrypted, at = False, len(body) - len(body.lstrip())
    while m := PEM_HEADER.match(body, at):
        encrypted, at = True, m.end()
    try:
        raw = base64.b64decode(re.sub(rb"\s+", b"", body[at:]), validate=True)
    except (ValueError, binascii.Error):
        return False
    if label.startswith(b"OPENSSH"):
        return raw.startswith(b"openssh-key-v1\0")
    return len(raw) > 0 and len(raw) % 8 == 0 if encrypted else der_length(raw) == len(raw)


#: Kind: its expression at a hit, and what a match must satisfy.
ANCHORED = {
    "assign": (ASSIGN, lambda m: len(m[1]) >= 8),
    "access": (ACCESS, lambda m: len(m[0]) >= 16),
    "forge": (FORGE, forge_checks),
    "jwt": (JWT, jwt_checks),
    "wif": (WIF, wif_checks),
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def scan(text: str, words: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    data = text.encode("utf-8", "surrogatepass")
    spans: list[tuple[int, int, int]] = []
    free, opened = dict.fromkeys(KINDS, 0), None
    # bytes.lower() changes A-Z alone; as Latin-1, one character stands for one byte
    for last, (kind, n) in words.iter(data.lower().decode("latin-1")):
        start = last - n + 1
        if start < free[kind]:
            continue
        if kind == "pem":  # each stretch between two such lines is looked at once
            if m := PEM_LINE.match(data, start):
                if m[1] == b"BEGIN":
                    opened = m
                elif opened:
                    if opened[2] == m[2] and pem_checks(m[2], data[opened.end() : start]):
                        spans.append((opened.start(), KINDS.index(kind), m.end()))
                    opened = None
            continue
        expression, holds = ANCHORED[kind]
        if m := expression.match(data, start):
            free[kind] = m.end()
            if holds(m):
                spans.append((start, KINDS.index(kind), m.end()))
        elif kind == "jwt" and (m := JWT_RUN.match(data, start)):
            free[kind] = m.end()  # no hit in this run can do better
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(data)]
    spans.sort()
    if not spans or len(data) == len(text):
        return [(KINDS[k], s, e) for s, k, e in spans]
    at, chars, points = 0, 0, {}  # byte offsets to code points, in one pass
    for place in sorted({x for s, _, e in spans for x in (s, e)}):
        chars += len(data[at:place].decode("utf-8", "surrogatepass"))
        at, points[place] = place, chars
    return [(KINDS[k], points[s], points[e]) for s, k, e in spans]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, kind = automaton(), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(x.as_py() or "", words)] for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans: array of (kind, start, end)) for each row of docs, in code points of the whole text, end exclusive.

    One pass without a shuffle. Null and empty texts have no spans; a null doc_id stays null; repeated rows each give their row; columns
    other than doc_id and text are ignored.
    """
    ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan_batches, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digests(found: DataFrame) -> DataFrame:
    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def of(*kinds):
        return F.filter("spans", lambda x: x["kind"].isin(*kinds))

    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(of(*BASE)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: secrets in all of `documents`."""
    return digests(find_secrets(table(spark, sf_dir, "documents")))
