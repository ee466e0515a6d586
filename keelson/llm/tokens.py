"""Tokenizer files and per-process encoders for whole texts.

A text is cut where its tokenizer certainly cuts as well (before a space that precedes a word, or at white space), and the
pieces, most of which recur, are looked up in a bounded cache; only pieces not seen before are tokenized.
"""

from __future__ import annotations

import os
import re
from array import array

CACHE_PIECES = 600_000
#: A space before something that is no white space. Python's class is wider than Unicode's, so a cut is never wrong.
BEFORE_WORD = re.compile(r" (?=\S)")
ODD_SPACE = re.compile(r" (?:\s|$)")
#: Unicode's White_Space, and what Python counts beyond it.
WHITE, NOT_WHITE = "\\t-\\r \x85\xa0  -     　", re.compile("[\x1c-\x1f]")
#: Pieces whose letters are classified alike by every Unicode version.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(f"[\t-~{LETTERS}]*")
#: Fixed value: the pre-tokenizer pattern of the byte-level vocabulary.
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: This pattern and that of the word vocabulary for plain pieces, which Python's own engine can match.
PLAIN_BYTE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\t-\r 0-9{LETTERS}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
PLAIN_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\t-\r 0-9{LETTERS}]+")


def byte_alphabet() -> dict:
    """The printable character that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves,
    the others take the code points from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary file on this machine; the package that has them is installed on every worker."""
    import public_tokenizers
    return public_tokenizers.path(name)


class PieceCache(dict):
    """piece -> ids as little-endian unsigned 32-bit integers; starts again when it is full."""

    def __init__(self, encode_piece, most: int = CACHE_PIECES):
        super().__init__()
        self.encode_piece, self.most = encode_piece, most

    def __missing__(self, piece):
        if len(self) >= self.most:
            self.clear()
        ids = self[piece] = self.encode_piece(piece)
        return ids


def packed(ids) -> bytes:
    return array("I", ids).tobytes()


class TextEncoder:
    """What `tokenizers` gives for a whole text without added special tokens, as packed ids.

    `by_word`: the vocabulary drops white space and lower-cases (word ends); else it is byte-level and keeps all bytes.
    """

    def __init__(self, path: str, by_word: bool, most: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word = by_word
        self.special = {t.content: packed([i]) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.alphabet = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        self.cache = PieceCache(self._word_piece if by_word else self._byte_piece, most)
        self.inner = PieceCache(self._model, most // 10)

    def _whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _model(self, word: str) -> bytes:
        if not word.isascii() or not word.isprintable() or " " in word:
            word = word.encode().decode("latin-1").translate(self.alphabet)
        return packed([t.id for t in self.tokenizer.model.tokenize(word)])

    def _byte_piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            return self._model(" " + piece)
        if not PLAIN.fullmatch(piece):
            return self._whole(" " + piece)
        first, *rest = PLAIN_BYTE.findall(" " + piece)
        if not rest:
            return self._model(first)
        # a word with punctuation behind it: the word alone is often known
        return (self.cache[first[1:]] if len(first) > 1 else self._model(first)) + b"".join(map(self.inner.__getitem__, rest))

    def _word_piece(self, piece: str) -> bytes:
        if not PLAIN.fullmatch(piece):
            return self._whole(piece)
        lower = piece.lower()
        if lower == piece and piece.isalpha():
            return self._model(piece)
        words = PLAIN_WORD.findall(lower)
        return self._model(piece) if words == [piece] else b"".join(map(self.cache.__getitem__, words))

    def encode(self, text: str) -> bytes:
        if self.split_special and "<|" in text:
            return b"".join(self.special.get(part) or self._segment(part) for part in self.split_special.split(text) if part)
        return self._segment(text)

    def _segment(self, text: str) -> bytes:
        if self.by_word:
            pieces = text.split() if not NOT_WHITE.search(text) else re.split(f"[{WHITE}]+", text)
            return b"".join(map(self.cache.__getitem__, pieces))
        first, *rest = BEFORE_WORD.split(text) if ODD_SPACE.search(text) else text.split(" ")
        return (self._whole(first) if first else b"") + b"".join(map(self.cache.__getitem__, rest))


_ENCODERS: dict = {}


def encoder(name: str) -> TextEncoder:
    """One encoder per worker process and vocabulary."""
    if name not in _ENCODERS:
        _ENCODERS[name] = TextEncoder(vocabulary_path(name), by_word=name.startswith("word"))
    return _ENCODERS[name]
