"""Secret scans: Aho-Corasick prefilter, anchored regular expressions at the hits, checksum validation.

One automaton holds the keywords of all kinds and, as "keywords" of the hexadecimal kind, all runs of four
hexadecimal digits. It reads the text once with A-Z lower-cased; only where it hits is a kind's regular expression
tried, anchored. Kinds with an embedded checksum (tokens that end in six base-62 digits of the CRC-32 of what goes
before) are reported only if the checksum holds.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from manyfold.llm.common import keyed

#: Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
HEX = re.compile(r"[0-9a-f]+", re.ASCII)
ASSIGN_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
BASE_KINDS = ("assign", "access", "hex")
#: Public token formats: prefix, 30 base-62 characters, 6 base-62 digits of the CRC-32 of these 30.
CHECKED_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])", re.ASCII)
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = (*BASE_KINDS, "checked")

SCHEMA = "_id long, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string"


def crc_digits(body: str) -> str:
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = BASE62[d] + digits
    return digits


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in ASSIGN_KEYWORDS:
        found.add_word(word, ("assign", len(word)))
    for word in CHECKED_PREFIXES:
        found.add_word(word, ("checked", len(word)))
    found.add_word("akia", ("access", 4))
    for gram in map("".join, itertools.product("0123456789abcdef", repeat=4)):
        found.add_word(gram, None)
    found.make_automaton()
    return found


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and kind; leftmost and non-overlapping within a kind."""
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    hits: dict[str, list[int]] = {"assign": [], "access": [], "checked": []}
    spans = []
    hex_end = -1
    for end, what in _automaton().iter(lowered):
        if what is None:
            if end > hex_end:  # not within the run that was looked at last
                m = HEX.match(text, end - 3)
                if m is None or m.end() <= end:
                    continue  # capitals
                hex_end = m.end() - 1
                if m.end() - m.start() >= 24:
                    spans.append(("hex", m.start(), m.end()))
        else:
            hits[what[0]].append(end + 1 - what[1])
    for kind, starts in hits.items():
        free = 0
        for start in sorted(starts):
            if start < free:
                continue
            if kind == "assign":
                m = ASSIGN.match(text, start)
                good = m is not None and len(m[2]) >= 6
            elif kind == "access":
                m = ACCESS.match(text, start)
                good = m is not None and m.end() - start >= 20
            else:
                m = CHECKED.match(text, start)
                good = m is not None and crc_digits(m[1]) == m[2]
            if m is not None:
                free = m.end()
            if good:
                spans.append((kind, start, m.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])
    for batch in batches:
        rows = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            spans = find_secrets(text.as_py())
            said = [f"{k}:{a}:{b}" for k, a, b in spans]
            base = ",".join(x for x, s in zip(said, spans, strict=True) if s[0] in BASE_KINDS)
            rows.append((i, *(sum(s[0] == k for s in spans) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(said)))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: _id, n_assign, n_access, n_hex, n_checked, base_sha256, spans.

    A null or empty text has no spans; base_sha256 is then that of the empty string. No shuffle.
    """
    return keyed(docs, id_col, text_col).mapInArrow(_scan, SCHEMA)



