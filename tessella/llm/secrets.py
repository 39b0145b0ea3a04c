"""Secret scanning: Aho-Corasick keyword prefilter, anchored regular expressions only
at hits, embedded checksum validation.

Kinds of spans (code points, end exclusive), in listed order:

* ``assign``  keyword, optional quote, ``:`` or ``=``, optional quote, a value of 8+
  characters; ``access`` AKIA ids of 16+ characters; ``hex`` runs of 32+ digits.
* ``github``, ``npm``: tokens whose last six characters are the base-62 CRC-32 of the
  rest; a wrong checksum drops the match.  ``pem``: private key headers.

The keyword automaton runs over the whole text; each regular expression is matched only
at a hit. Hexadecimal runs have no keyword; their prefilter is the run test itself.

Defined cases: a null or empty text has no spans; equal rows give equal results; input
columns other than the id and the text are ignored, whatever their names; an empty table
gives an empty result. Memory: one Arrow batch.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, tidied

KINDS = ("assign", "access", "hex", "github", "npm", "pem")
BASE = KINDS[:3]
# The patterns of the scan's contract and of public token formats.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")
_KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access"}
_KEYWORDS |= {f"gh{c}_": "github" for c in "pousr"} | {"npm_": "npm", "-----begin ": "pem"}
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_machine = None


def _automaton():
    global _machine
    if _machine is None:
        _machine = ahocorasick.Automaton()
        for word, kind in _KEYWORDS.items():
            _machine.add_word(word, (len(word), kind))
        _machine.make_automaton()
    return _machine


def base62_crc(text: str) -> str:
    """CRC-32 of the text in six base-62 digits, the checksum such tokens end with."""
    n, out = zlib.crc32(text.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _DIGITS[d] + out
    return out


def _checked(token: str) -> bool:
    body = token[4:]
    return base62_crc(body[:-6]) == body[-6:]


def find(text: str) -> list[tuple[int, int, int]]:
    """All spans of one text as (start, kind's number, end), sorted."""
    if not text:
        return []
    low = text.lower() if text.isascii() else text.encode().lower().decode()
    hits = sorted((end + 1 - size, kind) for end, (size, kind) in _automaton().iter(low))
    out, over = [], dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start < over[kind]:
            continue
        if kind == "assign":
            m = _ASSIGN.match(text, start)
            keep = m is not None and m.end(2) - m.start(2) >= 8
        elif kind == "access":
            m = _ACCESS.match(text, start)
            keep = m is not None and m.end() - m.start() >= 16
        elif kind == "pem":
            m = _PEM.match(text, start)
            keep = m is not None
        else:
            m = (_GITHUB if kind == "github" else _NPM).match(text, start)
            keep = m is not None and _checked(m[0])
        if m is None:
            continue
        over[kind] = m.end()
        if keep:
            out.append((start, KINDS.index(kind), m.end()))
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, spans array<struct<kind, start, end>>), one per input row."""
    source = text_of(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["id", "spans"])

    of = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(tidied(run), f"id {of}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts and digests of `scan`'s spans."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(F.col("id").alias(id_column), *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text_column: str = "text", size_column: str | None = "n_chars") -> DataFrame:
    """The same rows and columns; each stretch covered by spans becomes
    ``[REDACTED:<kind of its first span>]``. Null texts stay null. The size column, where
    there is one, holds the new number of code points."""
    names, where = docs.columns, docs.columns.index(text_column)

    def clean(text: str | None) -> str | None:
        spans = find(text) if text else []
        if not spans:
            return text
        out, at, i = [], 0, 0
        while i < len(spans):
            start, kind, end = spans[i]
            while i + 1 < len(spans) and spans[i + 1][0] < end:
                i += 1
                end = max(end, spans[i][2])
            out += [text[at:start], f"[REDACTED:{KINDS[kind]}]"]
            at, i = end, i + 1
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            texts = columns[where].to_pylist()
            columns[where] = pa.array([clean(t) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    out = docs.mapInArrow(tidied(run), docs.schema)
    if size_column in names:
        out = out.withColumn(size_column, F.char_length(F.col(text_column)).cast(docs.schema[size_column].dataType))
    return out.select(*names)


def python_digest(text: str | None) -> tuple[int, int, int, str]:
    """Brute force for tests: every pattern over the whole text, no prefilter."""
    text, spans = text or "", []
    for m in _ASSIGN.finditer(text):
        if len(m[2]) >= 8:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    n = [sum(k == i for _, k, _ in spans) for i in range(3)]
    return (*n, hashlib.sha256(said.encode()).hexdigest())
