"""Whole-text encoding with a public tokenizer, through bounded caches of chunks and pieces."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: Chunks and pieces that one Python worker remembers; beyond it, those not met again are let go.
CACHE_CHUNKS, CACHE_PIECES = 200_000, 300_000

# The letters, in ASCII and the Latin blocks, whose lower case is one letter and which no normalization changes.
_LETTER = "a-zß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįĵķĺļľłńņňōŏőŕŗřśŝşšţťŧũūŭůűųŵŷźżž"
_CAPITAL = "A-ZÀ-ÖØ-Þ"
#: Chunks that are cut here rather than by the tokenizer.
_PLAIN = re.compile(rf"[!-~{_LETTER}{_CAPITAL}]*")
# The tokenizer's own split pattern, on lower-cased plain chunks.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^0-9{_LETTER}]+")


# What a tokenizer's file must declare for its texts to be cut here.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _cuts_as_here(path: str) -> bool:
    """Whether the file declares the rules by which :class:`WordEncoder` cuts texts."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not any(spec.get(k) for k in ("post_processor", "truncation", "padding"))
    marks = all(t["content"].startswith("<|") and " " not in t["content"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec["added_tokens"])
    return plain and marks and spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _SPLIT


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the letters from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class _Cache(dict):
    """Two generations: a full young one becomes the old one, whose entries move up when met again."""

    def __init__(self, make, limit: int):
        super().__init__()
        self._make, self._limit, self._older = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self._limit:
            self._older = dict(self)
            self.clear()
        found = self._older.get(key)
        self[key] = found = self._make(key) if found is None else found
        return found


class WordEncoder:
    """Ids of whole texts as little-endian uint32 bytes.

    The tokenizer drops white space and never joins anything across it (no composition, contraction or merge does), so
    a text's ids are those of its chunks between ASCII white space, in order. A chunk of plain letters, digits and
    marks is cut into the tokenizer's pieces, each merged by its model; any other chunk goes through it whole. That holds
    for files that declare these rules (``_cuts_as_here``); texts for any other tokenizer are encoded by it in one piece.
    """

    def __init__(self, path: str, chunks: int = CACHE_CHUNKS, pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._own = _cuts_as_here(path)
        self._model = self._tokenizer.model
        self._letters = _byte_letters()
        self._pieces = _Cache(self._piece, pieces)
        self._chunks = _Cache(self._chunk, chunks)

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join([self._letters[b] for b in piece.encode()])
        return array("I", [t.id for t in self._model.tokenize(piece)]).tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # of bytes: ASCII letters alone
            return self._pieces[chunk.lower().decode("ascii")]
        if chunk[-1] in b".,;:!?" and chunk[:-1].isalpha():
            return self._pieces[chunk[:-1].lower().decode("ascii")] + self._pieces[chr(chunk[-1])]
        text = chunk.decode("utf-8")
        if _PLAIN.fullmatch(text) is None or "<|" in text:
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join([self._pieces[p] for p in _PIECES.findall(text.lower())])

    def encode(self, text: bytes, tail: bytes = b"") -> bytes:
        """Ids of ``text`` followed by ``tail``."""
        if not self._own:
            return np.array(self._tokenizer.encode(text.decode("utf-8"), add_special_tokens=False).ids, dtype="<u4").tobytes() + tail
        return b"".join(map(self._chunks.__getitem__, text.split())) + tail


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process, so that its caches outlive a task."""
    return WordEncoder(path)
