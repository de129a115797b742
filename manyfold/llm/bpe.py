"""Byte-level BPE by dynamic programming over prefixes.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours are compatible, that is, if the
bytes of the two together encode to just these two. So every prefix of a piece has one last token, and the table
``last`` of these tokens is all that an encoding needs: appending bytes adds entries, and after an edit only the
entries from the edit on, until they agree again, change. ``ids`` reads the table backwards.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from manyfold.llm.common import keyed

#: Pieces of up to 64 characters that a worker keeps with their ids in each of two generations.
CACHE = 250_000
#: Pairs of tokens with their compatibility kept by each worker, at most.
PAIRS = 2_000_000
SCHEMA = "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def merge_ranks(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The definition: join the neighbours of the lowest rank, leftmost first, until none can be joined."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in ranks), default=None)
        if best is None:
            break
        k = best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


class PrefixEncoder:
    """Encodes pieces with a vocabulary of ranks (bytes -> id)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pattern = regex.compile(pattern)
        #: Tokens that their own bytes encode to; the others never occur in an encoding.
        self.reachable = {b: i for b, i in ranks.items() if merge_ranks(b, ranks) == [i]}
        #: Every suffix of such a token: its own id if it is one itself, else -1.
        self.suffix: dict[bytes, int] = {b[k:]: -1 for b in self.reachable for k in range(1, len(b))} | self.reachable
        self._pair: dict[int, bool] = {}
        self._old: dict[str, tuple[int, ...]] = {}
        self._cache: dict[str, tuple[int, ...]] = {}

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self._pair.get(key)
        if known is None:
            if len(self._pair) >= PAIRS:
                self._pair.clear()
            known = self._pair[key] = merge_ranks(self.bytes_of[left] + self.bytes_of[right], self.ranks) == [left, right]
        return known

    def last_token(self, piece: bytes, end: int, last: list[int]) -> int:
        """The last token of piece[:end], given those of all shorter prefixes (last[n - 1] for n bytes)."""
        token_of, pairs = self.suffix.get, self._pair.get
        for start in range(end - 1, -1, -1):
            token = token_of(piece[start:end])
            if token is None:
                break
            if token < 0:
                continue
            if start == 0:
                return token
            known = pairs(last[start - 1] << 32 | token)
            if known or known is None and self.compatible(last[start - 1], token):
                return token
        raise ValueError("the vocabulary lacks single bytes")

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """The table of a piece, of whose first len(last) bytes it is known."""
        for end in range(len(last) + 1, len(piece) + 1):
            last.append(self.last_token(piece, end, last))
        return last

    def edit(self, old: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """old[start:end] replaced by new: the piece and its table.

        Entries before the edit stay. Those after it are computed anew until, for as many bytes as the longest token
        has, they are what they were; from there on an entry depends on equal entries only, so the rest is taken over.
        """
        piece = old[:start] + new + old[end:]
        table, shift, same = last[:start], len(new) - (end - start), 0
        for stop in range(start + 1, len(piece) + 1):
            table.append(self.last_token(piece, stop, table))
            before = stop - shift
            same = same + 1 if stop > start + len(new) and table[-1] == last[before - 1] else 0
            if same >= self.longest:
                table.extend(last[before:])
                break
        return piece, table

    def ids(self, last: list[int]) -> list[int]:
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes_of[last[at - 1]])
        return out[::-1]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        known = self._cache.get(piece)
        if known is None:
            known = self._old.get(piece)
            if known is None:
                raw = piece.encode("utf-8")
                whole = self.reachable.get(raw)
                known = (whole,) if whole is not None else tuple(self.ids(self.extend(raw, [])))
            if len(piece) <= 64:
                if len(self._cache) >= CACHE:
                    self._old, self._cache = self._cache, {}
                self._cache[piece] = known
        return known

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.encode_piece, self.pattern.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


@lru_cache(maxsize=2)
def _encoder(raw: bytes, pattern: str) -> PrefixEncoder:
    """One to a worker for each vocabulary and pattern."""
    return PrefixEncoder(parse_ranks(raw), pattern)


def bpe_encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: _id, n_tokens, ids_sha256, decoded_sha256 (and ids array<int> if asked for).

    vocabulary is a file of base64 tokens and ranks on the driver (some megabytes at most); its content is broadcast. Each match of pattern
    is encoded by itself. A null or empty text has no tokens. No shuffle.
    """
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value, pattern)
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for text in batch.column(1):
                ids = encoder.encode(text.as_py())
                columns[0].append(len(ids))
                columns[1].append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                columns[2].append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                if with_ids:
                    columns[3].append(ids)
            arrays = [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
            names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(columns[3], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return keyed(docs, id_col, text_col).mapInArrow(encode, SCHEMA + ", ids array<int>" * with_ids)
