"""Statistics of whole documents as rows of numbers."""

from __future__ import annotations

import numpy as np

from manyfold.llm.common import text_chunks, window_hashes, word_hashes, word_spans

_CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "comma", "bar", "shout", "symbol", "quote", "high")
_CLASS_OF = np.full(256, 9, np.uint8)
for _name, _bytes in {
    0: range(97, 123), 1: range(65, 91), 2: range(48, 58), 3: (32, 9, 11, 12, 13), 4: (10,), 5: (46,), 6: (44, 59, 58), 7: (124,), 8: (33, 63), 10: (34, 39, 40, 41, 45), 11: range(128, 256),
}.items():
    _CLASS_OF[list(_bytes)] = _name

NAMES = (
    *(f"share_{c}" for c in _CLASSES),
    "log_words", "word_length", "word_length_spread", "short_words", "long_words", "repeats_next", "distinct_words", "distinct_pairs",
    "words_per_line", "distinct_lines", "words_per_stop", "upper_words",
)


def _distinct(texts: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((values, texts))
    t, v = texts[order], values[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
    return np.bincount(t[new], minlength=n)


def document_statistics(column) -> np.ndarray:
    """A row of NAMES for each text of an Arrow column; an empty text is all zero."""
    parts = [np.zeros((0, len(NAMES)))]
    for _, data, offsets in text_chunks(column):
        n = len(offsets) - 1
        size = np.diff(offsets)
        of = np.repeat(np.arange(n, dtype=np.int32), size)
        counts = np.bincount(of * np.int32(len(_CLASSES)) + _CLASS_OF[data], minlength=n * len(_CLASSES)).reshape(n, len(_CLASSES))
        start, end, first = word_spans(data, offsets)
        words = np.diff(first)
        text = np.repeat(np.arange(n), words)
        hashes = word_hashes(data, start, end)
        length = (end - start).astype(float)
        many = np.maximum(words, 1)
        by = lambda weight: np.bincount(text, weight, n) / many
        mean = by(length)
        spread = np.sqrt(np.maximum(by(length * length) - mean * mean, 0))
        joined = text[1:] == text[:-1]
        pairs = window_hashes(hashes, 2)
        ends_line = np.zeros(256, bool)
        ends_line[10] = True
        l_start, l_end, l_first = word_spans(data, offsets, ends_line)
        lines = np.diff(l_first)
        l_text = np.repeat(np.arange(n), lines)
        upper = (data[start] >= 65) & (data[start] <= 90) & (length > 1) & (data[np.minimum(start + 1, len(data) - 1)] >= 65) & (data[np.minimum(start + 1, len(data) - 1)] <= 90) if len(start) else np.zeros(0, bool)
        columns = [
            np.log1p(words), mean, spread, by(length <= 2), by(length >= 12),
            np.bincount(text[1:], joined & (hashes[1:] == hashes[:-1]), n) / many if len(text) else np.zeros(n),
            _distinct(text, hashes, n) / np.sqrt(many),
            _distinct(text[1:][joined], pairs[joined], n) / many if len(text) else np.zeros(n),
            np.log1p(words / np.maximum(lines, 1)),
            _distinct(l_text, word_hashes(data, l_start, l_end), n) / np.maximum(lines, 1),
            np.log1p(words / (counts[:, 5] + 1)),
            by(upper),
        ]
        parts.append(np.column_stack([counts / np.maximum(size, 1)[:, None], *columns]))
    return np.concatenate(parts)


