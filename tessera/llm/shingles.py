"""Word shingles of texts, and small blocks of numbers that tasks send each other."""

from __future__ import annotations

import numpy as np
import xxhash
import zstandard


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the text's word shingles, repeats included.

    A-Z are lower-cased, words are runs of anything but white space; a text with
    fewer words than ``size`` has its whole word sequence as one shingle.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    starts = ends - length
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64, n)


def pressed(text: str | None) -> bytes:
    """A text compressed, for tables that are written and exchanged; null counts as empty."""
    return zstandard.compress((text or "").encode("utf-8", "surrogatepass"))


def shingle_set(packed: bytes, size: int) -> np.ndarray:
    """The different ``shingle_hashes`` of a compressed text, in order."""
    return np.unique(shingle_hashes(zstandard.decompress(packed).decode("utf-8", "surrogatepass"), size))


def block(*columns: np.ndarray) -> bytes:
    """Columns of numbers (not negative) as one compressed block; each takes as many bytes as its largest number."""
    parts = [np.array([len(columns)], "<u8").tobytes()]
    for c in columns:
        width = max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1
        planes = np.ascontiguousarray(c, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
        parts += [np.array([len(c), width], "<u8").tobytes(), planes.tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def columns_of(packed: bytes) -> list[np.ndarray]:
    """The columns of a ``block``."""
    raw = zstandard.decompress(packed)
    at, out = 8, []
    for _ in range(int(np.frombuffer(raw, "<u8", 1)[0])):
        n, width = (int(x) for x in np.frombuffer(raw, "<u8", 2, at))
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 16).reshape(width, n).T
        out.append(wide.view("<u8").ravel())
        at += 16 + n * width
    return out
