"""Byte-level BPE by dynamic programming over prefixes.

The encoding of every prefix of a piece ends in exactly one token. A table keeps that token for each prefix: of the vocabulary's
tokens that end at a place, it is the one that may follow the last token of the prefix before it. Two tokens may be neighbours
if no merge across their border comes before the merges that build them. The ids of any prefix are read back from the table, so
an append only adds rows to it, and an edit recomputes rows from the changed byte on until they agree with the old ones over
the length of the longest token, from where the old rows hold.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import batch
from .tokens import BEFORE_WORD, BYTE_PATTERN, CACHE_PIECES, ODD_SPACE, PieceCache, packed, vocabulary_path

#: Longer pieces are encoded again instead of being kept.
KEPT_CHARS = 200
PAIRS = 1_000_000
NEVER = 1 << 62
#: No match of the pattern depends on more characters behind its end than these.
LOOKAHEAD = 3


class Neighbours(dict):
    """(token, next token) -> whether the encoding of their joined bytes keeps both; starts again when it is full."""

    def __init__(self, merged: dict, parts: dict):
        super().__init__()
        self.merged, self.parts = merged, parts

    def __missing__(self, pair):
        if len(self) >= PAIRS:
            self.clear()
        answer = self[pair] = self.judge(*pair)
        return answer

    def judge(self, left: int, right: int) -> bool:
        """Go back in time through the parts that touch the border. `before` is the rank at which the present parts are used up:
        a merge across the border of a smaller rank would have come first. Of equal ranks the left place comes first."""
        before = NEVER
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            if left > right and left in self.parts:
                before, left = left, self.parts[left][1]
            elif right in self.parts:
                before, right = right + 1, self.parts[right][0]
            else:
                return True


class PrefixBpe:
    """Encoder and decoder for a file of byte strings in base64 and their ranks.

    Every single byte must have a rank, and a token must rank behind the two it is merged from; the file is refused otherwise.
    Tokens that no merging reaches are only found as whole pieces, as tiktoken does.
    """

    def __init__(self, path: str, pattern: str = BYTE_PATTERN, most: int = CACHE_PIECES):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        single = [self.rank.get(bytes([b])) for b in range(256)]
        if None in single or max(single) > 255:
            raise ValueError(f"{path}: the single bytes must have the first 256 ranks")
        self.token = {i: t for t, i in self.rank.items()}
        merged, parts = {}, {}
        for token in sorted(self.rank, key=self.rank.__getitem__):
            if len(token) > 1 and (made := self._last_merge(token)):
                if max(made) >= self.rank[token]:
                    raise ValueError(f"{path}: {token!r} ranks before its parts")
                merged[made], parts[self.rank[token]] = self.rank[token], made
        self.neighbours = Neighbours(merged, parts)
        self.longest = max(map(len, self.rank))
        self.ending = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            if len(token) == 1 or rank in parts:
                self.ending.add_word(token.decode("latin-1"), (rank, len(token)))
        self.ending.make_automaton()
        self.matches = regex.compile(pattern)
        self.cache = PieceCache(lambda word: self._word(" " + word), most)
        self.inner = PieceCache(lambda piece: packed(self.piece(piece.encode())), most // 10)

    def _last_merge(self, token: bytes):
        """The two tokens whose merge completes this one, or None if merging its bytes by rank ends elsewhere."""
        cuts = [*range(len(token) + 1)]
        while len(cuts) > 3:
            ranks = [self.rank.get(token[cuts[k]:cuts[k + 2]], len(self.rank)) for k in range(len(cuts) - 2)]
            least = min(ranks)
            if least == len(self.rank):
                return None
            del cuts[ranks.index(least) + 1]
        return self.rank[token[:cuts[1]]], self.rank[token[cuts[1]:]]

    def extend(self, last: list, data: bytes) -> list:
        """Add the rows for the rest of `data` to the table of its first len(last) bytes. last[i] is the token that ends the
        first i + 1 bytes."""
        done, neighbours = len(last), self.neighbours
        start = max(0, done - self.longest)
        for end, (token, size) in self.ending.iter(data[start:].decode("latin-1") if start else data.decode("latin-1")):
            if end + start == done:
                before = done - size
                if before < 0 or neighbours[last[before], token]:
                    last.append(token)
                    done += 1
        return last

    def tokens(self, last: list) -> list:
        """The ids of the bytes whose table this is."""
        ids, at = [], len(last) - 1
        while at >= 0:
            ids.append(last[at])
            at -= len(self.token[last[at]])
        return ids[::-1]

    def replace(self, last: list, old: bytes, new: bytes, start: int, removed: int, added: int) -> tuple:
        """The table of `new`, which is `old` with `removed` bytes from `start` on replaced by `added` others, and the number
        of rows computed for it."""
        table, shift, same = last[:start], added - removed, 0
        while len(table) < len(new):
            if same == self.longest:
                kept = len(table)
                return table + last[kept - shift:], kept - start
            upto = min(len(new), len(table) + 64)
            self.extend(table, new[:upto])
            same = 0
            for at in range(upto - 1, start + added - 1, -1):
                if table[at] != last[at - shift] or same == self.longest:
                    break
                same += 1
        return table, len(new) - start

    def piece(self, data: bytes) -> list:
        """The ids of one match of the pattern; a piece that is a token itself is that token."""
        whole = self.rank.get(data)
        return self.tokens(self.extend([], data)) if whole is None else [whole]

    def _word(self, text: str) -> bytes:
        pieces = self.matches.findall(text)
        if len(pieces) > 1 and len(text) <= KEPT_CHARS:     # a word with marks behind it: the word alone is often known
            first = pieces[0]
            head = self.cache[first[1:]] if len(first) > 1 and first[0] == " " else self.inner[first]
            return head + b"".join(map(self.inner.__getitem__, pieces[1:]))
        return packed([i for piece in pieces for i in self.piece(piece.encode())])

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers; strings of special tokens are plain text."""
        first, *rest = BEFORE_WORD.split(text) if ODD_SPACE.search(text) else text.split(" ")
        return self._word(first) + b"".join([self.cache[w] if len(w) <= KEPT_CHARS else self._word(" " + w) for w in rest])

    def decode(self, ids: bytes) -> bytes:
        """The bytes of packed ids; they need not be UTF-8."""
        return b"".join(map(self.token.__getitem__, memoryview(ids).cast("I")))


class PrefixText:
    """A text with the prefix tables of its pieces, for appends and edits that compute only what changes."""

    def __init__(self, bpe: PrefixBpe, text: str):
        self.bpe, self.text, self.computed = bpe, text, 0
        self.pieces = []        # (start, end, table), in characters; the table is None for a piece that is a token
        self._split(0, [], 0)

    def _table(self, start: int, end: int):
        data = self.text[start:end].encode()
        if data in self.bpe.rank:
            return None
        self.computed += len(data)
        return self.bpe.extend([], data)

    def _split(self, at: int, old: list, shift: int, change: tuple | None = None):
        """Match from `at` on; take over the old pieces from where a match begins at one of them behind the change."""
        follow = {start + shift: k for k, (start, _, _) in enumerate(old)}
        for m in self.bpe.matches.finditer(self.text, at):
            k = follow.get(m.start())
            if k is not None and change and m.start() >= change[0] + change[2]:
                self.pieces += [(s + shift, e + shift, t) for s, e, t in old[k:]]
                return
            self.pieces.append((m.start(), m.end(), self._renewed(m.start(), m.end(), old, change)))

    def _renewed(self, start: int, end: int, old: list, change: tuple | None):
        """The table of a new piece, from that of the old piece at the same place if it had one."""
        if change:
            at, removed, added, before = change
            for s, e, table in old:
                if s == start and table is not None and s <= at <= e and at + added <= end and at + removed <= e:
                    was, now = before[s:e].encode(), self.text[start:end].encode()
                    tail_was, tail_now = before[at + removed:e].encode(), self.text[at + added:end].encode()
                    if tail_was == tail_now and now not in self.bpe.rank:
                        head = len(before[s:at].encode())
                        renewed, rows = self.bpe.replace(table, was, now, head, len(was) - head - len(tail_was),
                                                         len(now) - head - len(tail_now))
                        self.computed += rows
                        return renewed
                    break
        return self._table(start, end)

    def edit(self, at: int, removed: int, added: str) -> None:
        """Replace `removed` characters from `at` on; places beyond the text's ends are moved to them."""
        at = min(max(at, 0), len(self.text))
        removed = min(max(removed, 0), len(self.text) - at)
        keep = 0
        while keep < len(self.pieces) and self.pieces[keep][1] <= at - LOOKAHEAD:
            keep += 1
        old, before = self.pieces[keep:], self.text
        self.pieces = self.pieces[:keep]
        self.text = before[:at] + added + before[at + removed:]
        self._split(self.pieces[-1][1] if keep else 0, old, len(added) - removed, (at, removed, len(added), before))

    def append(self, tail: str) -> None:
        self.edit(len(self.text), 0, tail)

    def ids(self) -> bytes:
        bpe = self.bpe
        return packed([i for s, e, table in self.pieces
                       for i in ([bpe.rank[self.text[s:e].encode()]] if table is None else bpe.tokens(table))])


_CODERS: dict = {}


def coder(vocabulary: str) -> PrefixBpe:
    """One coder per worker process and vocabulary."""
    if vocabulary not in _CODERS:
        _CODERS[vocabulary] = PrefixBpe(vocabulary_path(vocabulary))
    return _CODERS[vocabulary]


def prefix_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per input row: the identifier and `ids`, the whole text's tokens as little-endian unsigned 32-bit integers.

    Null text counts as empty and has no ids; null and repeated identifiers are kept as they are, and so are repeated rows;
    other columns are not read, whatever they are called. An empty table gives an empty one. The time grows with a text's
    length, also for texts of one long piece.
    """
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_x_text"))

    def encoded(batches):
        bpe = coder(vocabulary)
        for b in batches:
            ids = pa.array([bpe.encode(t) for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_col, "ids"])

    return rows.mapInArrow(encoded, rows.select(id_col, F.lit(b"").alias("ids")).schema)


def prefix_decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per input row: the identifier and `content`, the bytes that the ids stand for; null ids give null."""
    rows = df.select(F.col(id_col), F.col(ids_col).alias("_x_ids"))

    def decoded(batches):
        bpe = coder(vocabulary)
        for b in batches:
            content = pa.array([None if i is None else bpe.decode(i) for i in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), content], names=[id_col, "content"])

    return rows.mapInArrow(decoded, rows.select(id_col, F.lit(None).cast("binary").alias("content")).schema)


def prefix_reencode(df: DataFrame, edits_col: str, id_col: str = "doc_id", text_col: str = "text",
                    vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Texts with a list of edits each: the ids of the edited text, and how many table rows the edits computed.

    `edits_col`: array of struct (at, removed, added), places in characters, applied in order; an edit at the end is an append.
    Null texts, edit lists, edits and additions count as empty, null places as 0. One row per input row: the identifier, `text`
    (after the edits), `ids`, `computed`; other columns are not read.
    """
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_x_text"), F.col(edits_col).alias("_x_edits"))
    out = rows.select(id_col, F.lit("").alias("text"), F.lit(b"").alias("ids"), F.lit(0).cast("bigint").alias("computed"))

    def edited(batches):
        bpe = coder(vocabulary)
        for b in batches:
            texts, ids, computed = [], [], []
            for text, edits in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                held = PrefixText(bpe, text)
                first = held.computed
                for e in edits or []:
                    at, removed, added = e.values() if e else (0, 0, "")
                    held.edit(at or 0, removed or 0, added or "")
                texts.append(held.text)
                ids.append(held.ids())
                computed.append(held.computed - first)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(ids, pa.binary()),
                                              pa.array(computed, pa.int64())], names=[id_col, "text", "ids", "computed"])

    return rows.mapInArrow(edited, out.schema)


DIGEST = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def prefix_round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Encode every text, decode the ids again, and return the digests of both; neither leaves the worker.

    Rows, nulls and other columns as in prefix_encode; a null or empty text has 0 tokens and the digests of no bytes.
    """
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_x_text"))
    out = rows.select(id_col, F.lit(0).cast("bigint").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256"))

    def digests(batches):
        bpe = coder(vocabulary)
        for b in batches:
            n, ids_sha, content_sha = [], [], []
            for text in b.column(1).to_pylist():
                ids = bpe.encode(text)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                content_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), *batch(DIGEST, (n, ids_sha, content_sha)).columns],
                                             names=[id_col, *DIGEST.names])

    return rows.mapInArrow(digests, out.schema)
