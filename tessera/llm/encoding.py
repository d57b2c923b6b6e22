"""Encoding of whole texts with a public tokenizer file, a batch at a time.

Running text repeats most of its words, so a text is cut where no token can
cross, each different piece is encoded once by the library's own BPE model, and
the ids are gathered by position.  The cuts are exact: a text for which they
would not be is handed to the library whole.  ``tests/llm`` compares the two.
"""

from __future__ import annotations

import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 3_000_000
#: Pieces whose ids a worker remembers; later ones are encoded each time.
REMEMBER = 350_000
#: White space before a space, where a cut at the space would split a run.
RUN = r"[\s\pZ\x0b\x1c-\x1f\x85] "

_byte_chars: dict[int, str] | None = None


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level BPE files."""
    global _byte_chars
    if _byte_chars is None:
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        _byte_chars = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return _byte_chars


class Encoder:
    """Ids of texts as ``tokenizer.encode(text, add_special_tokens=False)`` gives them.

    ``kind`` is ``"byte"`` for a byte-level BPE that keeps white space and ``"word"``
    for one that drops it and lower-cases.
    """

    #: The pre-token patterns of the two tokenizer files.
    PATTERNS = {
        "byte": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
        "word": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    }

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.kind = kind
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.find = regex.compile(self.PATTERNS[kind]).findall
        self.known: dict[str, bytes] = {}
        self.table = byte_chars()
        self.code = "H" if self.dtype.itemsize == 2 else "I"

    def _pre_token(self, p: str) -> bytes:
        ids = self.known.get(p)
        if ids is None:
            mapped = p.encode().decode("latin-1").translate(self.table)
            ids = array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()
            if len(self.known) < REMEMBER:
                self.known[p] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that no token leaves."""
        asked = piece
        if self.kind == "word" and not piece.isascii():
            piece = unicodedata.normalize("NFC", piece)
            piece = "".join([c.lower() for c in piece])  # by character, as the library does
        elif self.kind == "word":
            piece = piece.lower()
        if piece.isalpha() or self.kind == "byte" and piece[:1] == " " and piece[1:].isalpha():
            return self._pre_token(piece)
        found = self.find(piece)
        ids = b"".join([self._pre_token(p) for p in found])
        if len(found) > 1 and len(self.known) < REMEMBER:
            self.known.setdefault(asked, ids)
        return ids

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        known = self.known.get
        return [ids if (ids := known(p)) is not None else self._piece(p) for p in pieces]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        odd = np.zeros(n, bool)
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if self.kind == "byte":
            odd |= pc.match_substring_regex(texts, RUN).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        if self.kind == "word":
            plain = pc.replace_substring(plain, "\n", " ")
        units = pc.split_pattern(plain, " ")
        starts = units.offsets.to_numpy().astype(np.int64)
        starts = starts - starts[0]
        coded = units.flatten().dictionary_encode()
        codes = np.array(coded.indices)
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.kind == "byte":
            pieces = self._pieces([" " + w for w in words])
            firsts = units.flatten().take(pa.array(starts[:-1])).dictionary_encode()
            pieces += self._pieces(firsts.dictionary.to_numpy(zero_copy_only=False).tolist())
            codes[starts[:-1]] = len(words) + firsts.indices.to_numpy()
        else:
            pieces = self._pieces(words)
        del plain, units, coded, words  # as large as the texts; the ids need the room
        flat = pa.array(pieces, pa.large_binary()).take(pa.array(codes))
        del pieces, codes
        before = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1) // self.dtype.itemsize
        ids = np.frombuffer(flat.buffers()[2] or b"", self.dtype)[before[0] : before[-1]]
        lengths = before[starts[1:]] - before[starts[:-1]]
        if odd.any():
            parts, at_doc = [], np.concatenate([[0], np.cumsum(lengths)])
            for i in range(n):
                if odd[i]:
                    own = self.whole(texts[i].as_py())
                    lengths[i] = len(own)
                else:
                    own = ids[at_doc[i] : at_doc[i + 1]]
                parts.append(own)
            ids = np.concatenate(parts) if parts else ids
        return lengths, ids

    def encode(self, texts: pa.Array):
        """Yield ``(first row, lengths, flat ids)`` for successive slices of the texts; null counts as empty."""
        texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        at = 0
        while at < len(texts):
            end, room = at + 1, SLICE_BYTES - int(sizes[at])
            while end < len(texts) and room >= sizes[end]:
                room -= int(sizes[end])
                end += 1
            yield at, *self._slice(texts.slice(at, end - at))  # held by whoever asked, not here
            at = end


_held: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """This worker's encoder for a file; workers are reused, so it is loaded once."""
    if (path, kind) not in _held:
        _held[path, kind] = Encoder(path, kind)
    return _held[path, kind]


def drop_encoders() -> None:
    """Give up this worker's encoders: a stage that needs none shouldn't hold their pieces."""
    _held.clear()
