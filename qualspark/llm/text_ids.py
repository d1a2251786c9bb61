"""Text to token ids inside tasks: a tokenizer of the `tokenizers` library behind bounded word caches.

Where a tokenizer drops white space and its splitting pattern never crosses it, a text's ids are the ids of its
white-space-free chunks, one after the other. Chunks repeat a lot; each is encoded once and kept as packed bytes. A
tokenizer that does otherwise on texts with all kinds of white space encodes whole texts.
"""

from __future__ import annotations

import functools
import re

import numpy as np

#: Entries after which a cache starts anew, so a worker's memory stays bounded.
MOST_CHUNKS, MOST_PIECES = 1_000_000, 700_000

#: White space at the ends of texts, between words, between marks and digits, and repeated.
_PROBES = ("a b", " a", "a ", "The  cat", "the\tcat", "the\n\ncat \r\n sat", "\x0ba\x0cb", "1 2  3", "a , b !", "é ü\nß")
_CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
#: Latin-1 letters (composed, so NFC keeps them), then marks that the tokenizer keeps together; anything else goes to the tokenizer whole.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class ChunkIds(dict):
    """Maps a white-space-free chunk to its packed ids; encodes on first sight."""

    def __init__(self, path: str, dtype: str, special_as_text: bool):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = special_as_text
        self._dtype, self._pieces = np.dtype(dtype), {}
        # Latin-1 letters need no normalisation but lower case and the model's byte letters; the model alone is faster.
        self._letters = _byte_letters()
        self._direct = all(self._whole(w) == self._model(w) for w in ("a", "The", "Zebra", "élévation", "ÜBERGRÖSSE", "straße", "ñçþ", "xqzjk", "!?", "."))

        self._cuts = all(self._whole(t) == b"".join([self[w] for w in _CHUNK.findall(t)]) for t in _PROBES)

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self._dtype).tobytes()

    def _whole(self, chunk: str) -> bytes:
        return self._pack(self._tokenizer.encode(chunk, add_special_tokens=False).ids)

    def _model(self, piece: str) -> bytes:
        piece = piece.lower()
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self._letters)
        return self._pack([t.id for t in self._tokenizer.model.tokenize(piece)])

    def _piece(self, piece: str) -> bytes:
        piece = piece.lower()
        if (ids := self._pieces.get(piece)) is None:
            if len(self._pieces) >= MOST_PIECES:
                self._pieces.clear()
            ids = self._pieces[piece] = self._model(piece)
        return ids

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= MOST_CHUNKS:
            self.clear()
        if self._direct and (m := _SIMPLE.fullmatch(chunk)):
            ids = self._piece(m[1]) + (self._piece(m[2]) if m[2] else b"")
        else:
            ids = self._whole(chunk)
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Packed ids of a whole text; null: no ids."""
        if not text:
            return b""
        if not self._cuts:
            return self._whole(text)
        # str.split() also parts at U+001C..U+001F, which the tokenizer does not drop.
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        return b"".join([self[w] for w in (_CHUNK.findall(text) if odd else text.split())])


@functools.lru_cache(maxsize=4)
def chunk_ids(path: str, dtype: str = "<u4", special_as_text: bool = False) -> ChunkIds:
    """One cache per Python worker and tokenizer."""
    return ChunkIds(path, dtype, special_as_text)
