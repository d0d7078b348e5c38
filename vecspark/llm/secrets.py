"""Secret scans: keyword automaton first, anchored expressions near its hits, then checksums.

One Aho-Corasick pass over each text finds the keywords of all kinds; an expression is
tried only at a hit. Runs of hexadecimal digits have no keyword and are found by their
run lengths over the whole buffer. Kinds with an embedded checksum or structure
(``github``, ``npm``: CRC-32; ``jwt``: two JSON objects; ``pem``: a DER sequence or an
OpenSSH key) are reported only if that holds. The work is linear in the text.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecspark.llm import textkit as tk
from vecspark.llm.chunks import bounded, on_batches, slim

#: Kinds in the order in which findings of one start are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE_KINDS = KINDS[:3]
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

# Keywords (compared in lower case) and the expressions tried where they start.
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt", "-----begin": "pem"}
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]{16,}")
PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]{32,})-----END \1-----")
JWT_RUN = re.compile(rb"[A-Za-z0-9_-]+")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True

FINDINGS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def checksum62(body: bytes) -> str:
    """CRC-32 of the body as six digits of base 62."""
    n, out = zlib.crc32(body), ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0")


def _sound(kind: str, m: re.Match) -> bool:
    if kind in ("github", "npm"):
        return checksum62(m[1]) == m[2].decode()
    if kind == "jwt":
        try:
            return all(isinstance(json.loads(base64.urlsafe_b64decode(p + b"=" * (-len(p) % 4))), dict) for p in (m[1], m[2]))
        except (ValueError, RecursionError):
            return False
    return _key_block(b"".join(m[2].split()))


def _key_block(body: bytes) -> bool:
    """Whether base64 text holds an OpenSSH key, or one DER sequence that is as long as it says."""
    try:
        data = base64.b64decode(body, validate=True)
    except binascii.Error:
        return False
    if data.startswith(b"openssh-key-v1\0"):
        return True
    if len(data) < 2 or data[0] != 0x30:
        return False
    if data[1] < 0x80:
        return len(data) == 2 + data[1]
    n = data[1] & 0x7F
    return 0 < n <= 4 and len(data) == 2 + n + int.from_bytes(data[2 : 2 + n], "big")


_EXPRESSIONS = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM, "jwt": JWT, "pem": PEM}
_automaton = None


def _keywords():
    global _automaton
    if _automaton is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            made.add_word(word, (len(word), kind))
        made.make_automaton()
        _automaton = made
    return _automaton


def _near_keywords(raw: bytes) -> list[tuple[int, int, str]]:
    """Byte spans of all kinds but hex; a match consumes its text even if it is then dropped."""
    found, until, refused = [], dict.fromkeys(KINDS, 0), 0
    hits = sorted((end + 1 - n, kind) for end, (n, kind) in _keywords().iter(raw.lower().decode("latin-1")))
    for at, kind in hits:
        if at < until[kind] or kind == "jwt" and at < refused:
            continue
        if not (m := _EXPRESSIONS[kind].match(raw, at)):
            if kind == "jwt" and (run := JWT_RUN.match(raw, at)):
                # What follows the run decides, so no other start in it can match.
                refused = run.end()
            continue
        until[kind] = m.end()
        if kind == "assign":
            keep = len(m[2]) >= MIN_VALUE
        elif kind == "access":
            keep = m.end() - at >= MIN_ACCESS
        else:
            keep = _sound(kind, m)
        if keep:
            found.append((at, m.end(), kind))
    return found


def _scan(column: pa.Array) -> list[list[tuple[int, int, str]]]:
    """Findings of each text, in code points, by start and kind."""
    buf, offs = tk.text_buffer(column)
    hexa = _HEX[buf]
    begin, stop = hexa.copy(), hexa.copy()
    begin[1:] &= ~hexa[:-1]
    stop[:-1] &= ~hexa[1:]
    full = offs[1:] > offs[:-1]
    begin[offs[:-1][full]] = hexa[offs[:-1][full]]
    stop[offs[1:][full] - 1] = hexa[offs[1:][full] - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    long = e - s >= MIN_HEX
    s, e = s[long], e[long]
    row = np.searchsorted(offs, s, "right") - 1
    found: list[list[tuple[int, int, str]]] = [[] for _ in range(len(column))]
    for d, a, b in zip(row.tolist(), s.tolist(), e.tolist(), strict=True):
        found[d].append((a - int(offs[d]), b - int(offs[d]), "hex"))
    raw = buf.tobytes()
    for d in range(len(column)):
        own = raw[offs[d] : offs[d + 1]]
        found[d] += _near_keywords(own)
        if not found[d]:
            continue
        if not own.isascii():
            points = np.concatenate(([0], np.cumsum((np.frombuffer(own, np.uint8) & 0xC0) != 0x80)))
            found[d] = [(int(points[a]), int(points[b]), k) for a, b, k in found[d]]
        found[d].sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return found


def _as_arrow(found: list) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in x] for x in found], _ARROW)


def _find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in tk.slices(batch, "text"):
        yield pa.RecordBatch.from_arrays([part.column(0), _as_arrow(_scan(part.column(1)))], ["doc_id", "findings"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """All findings of each whole text: ``doc_id`` and ``findings`` (kind, start, end in code points).

    One row per input row, with no shuffle. Null text counts as empty and has no findings;
    a null ``doc_id`` and repeated rows are returned as they come; columns other than
    ``doc_id`` and ``text`` are ignored; an empty table gives an empty result. Kinds may
    overlap each other; within a kind, matches are leftmost and do not overlap.
    """
    docs = slim(docs)
    return docs.mapInArrow(on_batches(_find), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("findings", FINDINGS)]))


def _blank(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    at, size = batch.schema.get_field_index("text"), batch.schema.get_field_index("n_chars")
    for part in tk.slices(batch, "text"):
        texts, lengths = part.column(at).to_pylist(), part.column(size).to_pylist() if size >= 0 else None
        for i, found in enumerate(_scan(part.column(at))):
            if not found:
                continue
            out, last = [], 0
            for a, b, kind in found:
                if a >= last:
                    out += [texts[i][last:a], f"[{kind.upper()}]"]
                last = max(last, b)
            texts[i] = "".join([*out, texts[i][last:]])
            if lengths and lengths[i] is not None:
                lengths[i] = len(texts[i])
        part = part.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
        yield part.set_column(size, batch.schema.field(size), pa.array(lengths, batch.schema.field(size).type)) if lengths else part


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The documents with every finding replaced by its kind in brackets; overlapping findings become one.

    All rows and columns stay; the ``n_chars`` of a changed text, where present and not null,
    is set to its new length. Rows without findings, null and empty texts do not change.
    """
    return bounded(docs).mapInArrow(on_batches(_blank), docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(F.concat_ws(",", F.transform(base, line)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("findings", line)).alias("spans"),
    )
