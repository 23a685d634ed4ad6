"""Token ids of whole texts by the ``tokenizers`` library, with a cache over the pieces between single spaces.

A byte-level tokenizer splits a text before it merges, and a single space between two other characters always
begins a new split. So the ids of a text are the ids of its pieces in order, and a piece seen before needs no new
encoding. Texts for which that does not hold (runs of white space around a space, added tokens inside the text) and
tokenizers of another kind are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: Pieces held per worker process, about 200 bytes each; the cache starts anew when it is full.
MAX_CACHED_PIECES = 1 << 20

_UNSAFE_SPACES = re.compile(r" \s* ")

# Letters, digits and the rest up to U+024F, where the classes of the tokenizer's own pattern are the same in every
# version of Unicode; pieces with other characters are split by the library.
_LATIN = re.compile("[\\n\\x21-\\x7e\\xa1-\\xac\\xae-\u024f]+")
_LETTERS, _DIGITS = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\u024f", "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^ \\n{_LETTERS}{_DIGITS}]+|\\n+(?!\\S)|\\n+")


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones themselves, others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = str.maketrans(_byte_letters())


class Encoder:
    """Encodes texts to arrays of ids with the tokenizer of ``path``, without special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            spec.get("model", {}).get("type") == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel"
            and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("truncation") and not spec.get("padding")
        )
        added = [t["content"] for t in spec.get("added_tokens", ())]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.pieces: dict[str, bytes] = {}
        self.splits: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        if _LATIN.fullmatch(piece, piece[0] == " ") and not piece.startswith(" \n"):
            return b"".join(map(self._split, _SPLIT.findall(piece)))
        parts = (part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(piece))
        return b"".join(array(self.code, [t.id for t in self.tokenizer.model.tokenize(part)]).tobytes() for part in parts)

    def _split(self, part: str) -> bytes:
        ids = self.splits.get(part)
        if ids is None:
            if len(self.splits) > MAX_CACHED_PIECES // 2:
                self.splits.clear()
            letters = part.encode().decode("latin-1").translate(_BYTE_LETTERS)
            ids = self.splits[part] = array(self.code, [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The ids of ``text``, as unsigned integers of two or four bytes."""
        if not text:
            return np.empty(0, self.dtype)
        if not self.by_piece or _UNSAFE_SPACES.search(text) or self.added is not None and self.added.search(text):
            return np.frombuffer(self._whole(text), self.dtype)
        first, *rest = text.split(" ")
        out = [self._piece(first)] if first else []
        known = self.pieces
        try:
            out += map(known.__getitem__, rest)
        except KeyError:
            if len(known) > MAX_CACHED_PIECES:
                known.clear()
            for piece in set(rest).difference(known):
                known[piece] = self._piece(f" {piece}")
            out = out[:1] if first else []
            out += map(known.__getitem__, rest)
        return np.frombuffer(b"".join(out), self.dtype)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)
