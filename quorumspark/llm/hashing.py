"""Hashes of the words of many texts at once, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import LOWER_BYTES, mixed

#: Bytes of text that are hashed at a time.
PIECE_BYTES = 2_000_000

_U = np.uint64


def numbers(seed: int, n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BYTE = numbers(1, 256) | _U(1)
#: Which bytes belong to words: anything but white space.
WORD_BYTES = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
#: Which bytes belong to runs of letters and digits; all beyond ASCII do.
LETTER_BYTES = np.array([b > 127 or chr(b).isalnum() for b in range(256)])


def pieces(texts: list[str | None]) -> Iterator[list[bytes]]:
    """The texts as UTF-8, in lists of about PIECE_BYTES; null is empty."""
    piece, size = [], 0
    for t in texts:
        raw = t.encode() if t else b""
        if piece and size + len(raw) > PIECE_BYTES:
            yield piece
            piece, size = [], 0
        piece.append(raw)
        size += len(raw)
    if piece:
        yield piece


def word_hashes(texts: list[bytes], inside: np.ndarray = WORD_BYTES, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts (A-Z in lower case, unless lower is False), and how many words each text
    has. Words are the longest runs of the bytes that inside marks."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined.translate(LOWER_BYTES) if lower else joined, np.uint8)
    within = inside[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], within]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    per_text = np.diff(np.concatenate([[0], np.searchsorted(starts, text_ends)]))
    if not len(starts):
        return np.empty(0, _U), per_text
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    at = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    weights = numbers(4, int(sizes.max()))
    return mixed(np.add.reduceat(_BYTE[data[within]] * weights[at], first) + sizes.astype(_U)), per_text
