"""Encoding with a tokenizers file, word by word, with a bounded memory of words already encoded.

The tokenizer at hand drops white space and never lets a token cross it: normalisation (NFC, white space, lower
case) and pre-splitting treat the text between two white-space characters on its own. So the ids of a text are the
ids of its words one after another, and frequent words need encoding once per worker. All ids come from the
library: its model encodes each piece, its normaliser and pre-tokenizer make the pieces of any word that is not
simple in the sense below. Files of another build are encoded text by text.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Callable, Hashable

from tokenizers import Tokenizer

#: The split pattern of the supported build, and its form for lower-case words of the simple kind (fixed values).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIMPLE_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: Printable ASCII and composed Latin-1 letters: normal as they stand, and lower case goes letter by letter.
SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: Its lower-case letters beyond ASCII; the byte form of a piece is that of its letters one after another.
LETTERS = [chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha()]
#: Characters at which str.split() divides though Unicode doesn't count them as white space.
SEPARATORS = "\x1c\x1d\x1e\x1f"
LONGEST_KEPT = 64
#: Bits that tell which words came before, and words kept in a generation of the memory, pieces among them.
SEEN_BITS, KEPT = 1 << 23, 250_000


class _Memory(dict):
    """Values made on first use. A full memory becomes the older generation, from which used keys come back.

    With ``twice`` a key is kept from its second use on: most distinct words of a corpus come once, and would push out
    the others. Which keys came before is told by one bit each; two keys that share a bit only cost memory.
    """

    def __init__(self, make, limit: int, twice: bool = False):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}
        self.seen = bytearray(SEEN_BITS >> 3) if twice else None

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if self.seen is not None:
                at = hash(key) % SEEN_BITS
                byte, bit = at >> 3, 1 << (at & 7)
                if not self.seen[byte] & bit:
                    self.seen[byte] |= bit
                    return value
        if len(key) <= LONGEST_KEPT:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
                if self.seen is not None:
                    self.seen = bytearray(SEEN_BITS >> 3)
            self[key] = value
        return value


def _word_wise(spec: dict) -> bool:
    """Whether the file is of the build described above."""
    normal = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if normal != ["NFC", "Replace", "Lowercase"] or [p.get("type") for p in splits] != ["Split", "ByteLevel"]:
        return False
    split, level = splits
    return (
        split["pattern"].get("Regex") == SPLIT and split["behavior"] == "Removed" and split["invert"]
        and not level["add_prefix_space"] and not level["use_regex"]
        and spec["normalizer"]["normalizers"][1]["content"] == " "
    )


class WordTokenizer:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kept: int = KEPT):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as file:
            self.word_wise = _word_wise(json.load(file))
        self._model = self.tokenizer.model
        self._packed_ids = [packed_id(i) for i in range(self.tokenizer.get_vocab_size())]
        self._bytes = str.maketrans({c: self._as_bytes(c) for c in LETTERS})
        self._words = _Memory(self._encode_word, kept, twice=True)

    def _as_bytes(self, letter: str) -> str:
        return "".join(piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(letter))

    def _encode_piece(self, piece: str) -> bytes:
        if not piece.isascii():  # ASCII stands for its own bytes
            piece = piece.translate(self._bytes)
        return b"".join([self._packed_ids[token.id] for token in self._model.tokenize(piece)])

    def _encode_any(self, word: str) -> bytes:
        normal = self.tokenizer.normalizer.normalize_str(word)
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
        return _packed([token.id for piece, _ in pieces for token in self._model.tokenize(piece)])

    def _encode_word(self, word: str) -> bytes:
        """Pieces are words as well (splitting a piece gives itself), so one memory holds both."""
        if word.isascii() and word.isalpha():
            pieces = [word.lower()]
        elif SIMPLE.fullmatch(word):
            pieces = SIMPLE_SPLIT.findall(word.lower())
        else:
            return self._encode_any(word)
        if pieces == [word]:
            return self._encode_piece(word)
        return b"".join(map(self._words.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        if self.word_wise and not any(c in text for c in SEPARATORS):
            return b"".join(map(self._words.__getitem__, text.split()))
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)


def _packed(ids) -> bytes:
    out = array("I", ids)
    return out.tobytes()


def packed_id(value: int) -> bytes:
    return _packed([value])


_held: dict = {}


def held(key: Hashable, make: Callable):
    """What an operator keeps in a Python worker from task to task, made on first use.

    A worker outlives its tasks and serves one operator after another. It holds one thing only: the memories of all
    operators together would count against the executor as long as the worker lives.
    """
    if key not in _held:
        _held.clear()
        gc.collect()  # a memory and the function that fills it refer to each other
        _held[key] = make()
    return _held[key]


def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker and file: the words it knows stay for later tasks."""
    return held((WordTokenizer, path), lambda: WordTokenizer(path))
