"""Secret scans with structural confirmation.

Three base kinds are found by their patterns alone. Further candidates, runs
of base64 or hex characters and dotted tokens, are reported only when decoding
confirms a structure:

* jwt: header and payload decode to JSON objects, and the header names an algorithm;
* der: the bytes are an ASN.1 sequence whose nested lengths add up exactly and that has a private key's form: a
  version and then a key's integers (PKCS#1, DSA), octets (SEC1) or an algorithm and octets (PKCS#8), or an
  algorithm and encrypted octets;
* ssh: an OpenSSH private key file's length-prefixed fields fill the bytes exactly, its public keys among them;
* pem: the lines between a BEGIN and the next END mark of a private key decode to der or ssh, or its headers
  name a cipher, an initial vector of that cipher's size, and the bytes are whole blocks of it;
* basic: decodes to printable user:password after the word Basic.

Public keys and certificates have structures of their own and are no secrets.
A run may follow anything that is no character of its alphabet, '=' included,
an escape such as \\n, whose letters are not taken for the run's own, or 0x.

Everything is decided from one text at a time, so the scan is a single map
without a shuffle, and a lost executor costs the texts it was reading. Every
pattern passes over a text once: its runs are possessive or begin where no run
goes on, so that no text takes more than time in proportion to its length.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "der", "ssh", "pem", "basic")

_ASSIGN = re.compile(
    r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_NAMES = re.compile("password|passwd|secret|token|api_?key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: A run, its padding, and whether it ends there.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+(=*+)(?=([A-Za-z0-9+/_-]?))")
#: The same where the text writes / as \/, as JSON may.
_SLASHED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]|\\/){24,}+(=*+)(?=([A-Za-z0-9+/_-]?))")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]*+")
_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{1,60})-----")
_BODY = re.compile(r"[A-Za-z0-9+/=\s\\:,.-]*+")
_CIPHER = re.compile(r"(AES-(?:128|192|256)-CBC|DES-(?:EDE3-)?CBC),([0-9A-Fa-f]+)")
_BASIC = re.compile(r"(?:\b|(?<=\\[nrt])|(?<=\\u[0-9a-fA-F]{4}))[Bb]asic\x20+((?:[A-Za-z0-9+/]|\\/){8,}={0,2})")
#: What follows the backslash of an escape; its letters look like the begin of a run.
_ESCAPE = re.compile(r"[bfnrt]|u[0-9a-fA-F]{4}")
_BREAK = re.compile(r"(?<!\\)\\++(?:[nrt]|(?=\s))")
_CODED = re.compile(r"(?<!\\)\\++u00(2[bBfF]|3[dD])")
_HEXES = re.compile(r"[0-9a-fA-F]+")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The spans of the three base kinds, each kind leftmost and non-overlapping."""
    out: list[Span] = []
    if (":" in text or "=" in text) and _NAMES.search(text.lower()):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _decoded(run: str) -> bytes | None:
    """The bytes of a hex or base64 run, in either alphabet and with or without padding."""
    if len(run) % 2 == 0 and _HEXES.fullmatch(run):
        return bytes.fromhex(run)
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der_item(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the contents of the item at `at`; None unless its length lies within `end`."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if n < 0x80:  # not the shortest form
            return None
    return (tag, at, at + n) if at + n <= end else None


#: Tags of an integer, octets, an object's name and a sequence.
_INTEGER, _OCTETS, _NAME, _SEQUENCE = 0x02, 0x04, 0x06, 0x30


def is_der(data: bytes, least: int = 24) -> bool:
    """A sequence that fills `data`, with well-formed contents down to the last byte, in a private key's form."""
    top = _der_item(data, 0, len(data))
    if len(data) < least or not top or top[0] != _SEQUENCE or top[2] != len(data):
        return False
    todo, first = [top], []
    while todo:
        item = todo.pop()
        at, end = item[1:]
        while at < end:
            found = _der_item(data, at, end)
            if not found:
                return False
            at = found[2]
            if item is top:
                first.append(found)
            if found[0] & 0x20:
                todo.append(found)
    return _is_private(data, first)


def _is_private(data: bytes, items: list[tuple[int, int, int]]) -> bool:
    """Whether these items of a key's sequence are a private key's and not a public key's or a certificate's."""
    tags = [tag for tag, *_ in items]
    named = [tag == _SEQUENCE and end > begin and data[begin] == _NAME for tag, begin, end in items]
    if tags[:2] == [_SEQUENCE, _OCTETS]:
        return len(items) == 2 and named[0]
    if not tags or tags[0] != _INTEGER or items[0][2] - items[0][1] != 1 or data[items[0][1]] > 3:
        return False
    return tags[1:6] == [_INTEGER] * 5 or tags[1:2] == [_OCTETS] or tags[1:3] == [_SEQUENCE, _OCTETS] and named[1]


_MAGIC = b"openssh-key-v1\0"


def _fields(data: bytes, at: int = 0, most: int | None = None) -> tuple[list[bytes], int]:
    """The length-prefixed fields from `at` on, up to `most`, and where they end (beyond the data if one is cut off)."""
    out: list[bytes] = []
    while at + 4 <= len(data) and (most is None or len(out) < most):
        n = int.from_bytes(data[at : at + 4], "big")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out, at


def is_ssh_public(data: bytes) -> bool:
    """Two or more length-prefixed fields, the first a key algorithm's name."""
    found, end = _fields(data)
    return end == len(data) and len(found) >= 2 and bool(re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]{3,60}", found[0]))


def is_ssh(data: bytes) -> bool:
    """An OpenSSH private key file: cipher, key derivation, its options, a number of keys, as many public keys, and the private part."""
    if not data.startswith(_MAGIC):
        return False
    head, at = _fields(data, len(_MAGIC), 3)
    if len(head) < 3 or at + 4 > len(data) or not all(re.fullmatch(rb"[a-z0-9@.-]{1,60}", x) for x in head[:2]):
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    rest, end = _fields(data, at + 4)
    return end == len(data) and 1 <= keys == len(rest) - 1 and len(rest[-1]) >= 8 and all(map(is_ssh_public, rest[:-1]))


def is_encrypted(head: list[str], data: bytes) -> bool:
    """Headers of an encrypted key: they say so, and cipher, initial vector and length agree."""
    named = {k.strip(): v.strip() for k, v in (x.split(":", 1) for x in head)}
    cipher = _CIPHER.fullmatch(named.get("DEK-Info", ""))
    if not cipher or named.get("Proc-Type", "").replace(" ", "") != "4,ENCRYPTED":
        return False
    block = 16 if cipher[1].startswith("AES") else 8
    return len(cipher[2]) == 2 * block and len(data) >= 16 and len(data) % block == 0


def _pem_bodies(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and contents of each BEGIN mark of a private key with the END mark of its name right after it."""
    begun = None
    for m in _MARK.finditer(text):
        if m[1] == "END" and begun and begun[2] == m[2] and "KEY" in m[2] and "PUBLIC" not in m[2]:
            if _BODY.fullmatch(text, begun.end(), m.start()):
                yield begun.start(), m.end(), text[begun.end() : m.start()]
        begun = m if m[1] == "BEGIN" else None


def is_jwt(token: str) -> bool:
    """Header and payload are JSON objects and the header names its algorithm."""
    parts = token.split(".")
    try:
        header, payload = (json.loads(_decoded(p) or b"") for p in parts[:2])
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)


def structure(run: str) -> str | None:
    """The kind that decoding confirms for a hex or base64 run, if any."""
    data = _decoded(run)
    if not data:
        return None
    return "ssh" if is_ssh(data) else "der" if is_der(data) else None


def _starts(text: str, start: int) -> list[int]:
    """Where the run found at `start` may begin: there, behind the letters of an escape whose backslash stands before, and behind 0x."""
    escape = _ESCAPE.match(text, start) if start and text[start - 1] == "\\" else None
    out = [start, escape.end()] if escape else [start]
    return out + [a + 2 for a in out if text.startswith(("0x", "0X"), a)]


def _unescaped(body: str) -> str:
    """`body` with the escapes of a string literal undone: line breaks, and the base64 characters that may be escaped."""
    if "\\" not in body:
        return body
    body = _CODED.sub(lambda m: chr(int(m.group(1), 16)), _BREAK.sub("\n", body))
    return body.replace("\\/", "/")


def confirmed_spans(text: str) -> list[Span]:
    """The further spans, each confirmed by its structure."""
    out: list[Span] = []
    for m in (_SLASHED if "\\/" in text else _RUN).finditer(text):
        if len(m[1]) > 2 or m[2]:
            continue
        for start in _starts(text, m.start()):
            if kind := structure(text[start : m.end()].replace("\\/", "/")):
                out.append((kind, start, m.end()))
                break
    if "eyJ" in text or "ewo" in text or "ey" in text and "." in text:
        for m in _DOTTED.finditer(text):
            start = next((a for a in _starts(text, m.start()) if is_jwt(text[a : m.end()])), None)
            if start is not None:
                out.append(("jwt", start, m.end()))
    if "-----BEGIN" in text:
        for start, end, body in _pem_bodies(text):
            lines = _unescaped(body).split("\n")
            data = _decoded("".join("".join(x for x in lines if ":" not in x).split()))
            if data and (is_der(data) or is_ssh(data) or is_encrypted([x for x in lines if ":" in x], data)):
                out.append(("pem", start, end))
    if "asic " in text:
        for m in _BASIC.finditer(text):
            data = _decoded(m.group(1).replace("\\/", "/")) or b""
            user, mark, word = data.partition(b":")
            if mark and user and word and all(32 <= b < 127 for b in data):
                out.append(("basic", *m.span()))
    return out


def spans_of(text: str | None) -> list[Span]:
    """All spans of one text by start, then kind as listed; code points, end exclusive. None has none."""
    return ordered(base_spans(text or "") + confirmed_spans(text or ""))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end), a row for each row of `docs`, in any order.

    Null and empty texts have an empty array; repeated rows repeat their result.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redacted_text(text: str, mark: str = "[REDACTED]") -> str:
    """`text` with every run of overlapping spans replaced by `mark`."""
    out, at = [], 0
    for _, start, end in spans_of(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with the secrets of `text` replaced, and n_chars, where it is a column, counted anew where text changed.

    All rows and all further columns stay as they are; null texts stay null.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (t := x.as_py()) is None else redacted_text(t) for x in batch.column(at)]
            columns = [*batch.columns]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    names = docs.columns
    at = names.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    if "n_chars" not in names:
        return docs.mapInArrow(each, schema)
    before = docs.withColumn("__before", F.length("text"))
    names = before.columns
    schema += ", __before int"
    out = before.mapInArrow(each, schema)
    same = F.length("text").eqNullSafe(F.col("__before"))
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text")).cast(kind)).drop("__before")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[number(k).alias(f"n_{k}") for k in BASE],
        F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"),
    )
