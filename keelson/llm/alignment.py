"""Alignment of two tokenizers' tokens over whole texts, and the counts of the token pairs that end together.

An array maps each id of A to the id of B with the same bytes. Where one A token meets one B token of the same bytes, the pair is
counted in a vector of A's vocabulary; only the other groups' pairs are shuffled. Texts are cut where both tokenizers certainly
cut as well, before a space between two characters that are no space; most of the words so found recur, and each worker keeps
their alignment.

`align_texts` is written once with a key of its own for every row. Its pairs are summed corpus-wide; what the vectors do not hold
comes back to the texts in two ways: pairs with over a 2**18th of all links (so fewer than 2**18 of them) in a broadcast array,
the others, each of which is rare, by a join.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stored
from .tokens import CACHE_PIECES, ODD_SPACE, TextEncoder, byte_alphabet, vocabulary_path

#: A space that both tokenizers put at the beginning of a token.
CUT = re.compile(r"(?<=[^ ]) (?=\S)")
SPACE = "▁"
#: Longer words are aligned again instead of being kept.
KEPT_CHARS = 200
#: Pairs in the broadcast array: fewer than this.
HEAVY = 1 << 18
FLUSH_BYTES = 8 << 20
FLUSH_PAIRS = 1 << 20


class PairAligner:
    """Both tokenizers, the id map, and the kept alignments of words.

    A: a byte-level vocabulary of the tokenizers library, given a space before the text. B: a sentencepiece model that adds the
    space itself. No piece of B may hold a space behind another character; the model is refused otherwise.
    """

    def __init__(self, a: str, b: str, most: int = CACHE_PIECES):
        from sentencepiece import SentencePieceProcessor
        self.words, self.b, self.most = TextEncoder(vocabulary_path(a), False, most), SentencePieceProcessor(model_file=vocabulary_path(b)), most
        self.a = self.words.tokenizer
        self.a.encode_special_tokens = True
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError(f"{b}: a piece holds a space behind another character")
        to_byte = {c: bytes([n]) for n, c in byte_alphabet().items()}
        words = self.a.get_vocab(with_added_tokens=True)
        self.a_size, self.b_size = max(words.values()) + 1, len(pieces)
        self.a_bytes = [b""] * self.a_size
        for word, i in words.items():
            self.a_bytes[i] = b"".join(to_byte.get(c) or c.encode() for c in word)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        # the first piece with the bytes; a byte token only where no other piece has them
        of_bytes = {}
        for i in sorted(range(self.b_size), key=lambda i: (self.b.is_byte(i), i)):
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                of_bytes.setdefault(self.b_bytes[i], i)
        special = set(self.a.get_added_tokens_decoder())
        self.same = np.array([-1 if i in special else of_bytes.get(t, -1) for i, t in enumerate(self.a_bytes)], np.int64)
        self.same_id, self.a_length, self.b_length = self.same.tolist(), [*map(len, self.a_bytes)], [*map(len, self.b_bytes)]
        self.kept: dict = {}

    def a_ids(self, word: str) -> list:
        """A's ids of a space and `word`."""
        if " " in word or not word:
            return self.a.encode(" " + word, add_special_tokens=False).ids
        return memoryview(self.words.cache[word]).cast("I").tolist()

    def word(self, text: str, a_ids: list, b_ids: list):
        """(groups as text, A tokens, B tokens, exact A ids, other pairs a * b_size + b) of a space and `text`; None if the
        bytes of the tokens are not these."""
        whole = b" " + text.encode()
        if b"".join([self.b_bytes[i] for i in b_ids]) != whole or b"".join([self.a_bytes[i] for i in a_ids]) != whole:
            return None
        if len(a_ids) == 1 == len(b_ids) and self.same_id[a_ids[0]] == b_ids[0]:
            return f"{a_ids[0]}|{b_ids[0]}", 1, 1, a_ids[0].to_bytes(4, "little"), b""
        a_size, b_size = self.a_length, self.b_length
        groups, exact, others = [], [], []
        i = j = left = right = 0
        while i < len(a_ids):
            first_i, first_j = i, j
            left += a_size[a_ids[i]]
            right += b_size[b_ids[j]]
            i, j = i + 1, j + 1
            while left != right:
                if left < right:
                    left += a_size[a_ids[i]]
                    i += 1
                else:
                    right += b_size[b_ids[j]]
                    j += 1
            last_a, last_b = a_ids[i - 1], b_ids[j - 1]
            if i - first_i == 1 == j - first_j:
                groups.append(f"{last_a}|{last_b}")
                if self.same_id[last_a] == last_b:
                    exact.append(last_a)
                    continue
            else:
                groups.append(f"{','.join(map(str, a_ids[first_i:i]))}|{','.join(map(str, b_ids[first_j:j]))}")
            others.append(last_a * self.b_size + last_b)
        return (";".join(groups), len(a_ids), len(b_ids), array("I", exact).tobytes(), array("q", others).tobytes())

    def learn(self, words: list) -> dict:
        """word -> its alignment, for words not kept; keeps the short ones and starts again when they are too many."""
        if len(self.kept) + len(words) > self.most:
            self.kept.clear()
        a_ids = [self.a_ids(w) for w in words]
        b_ids = self.b.encode(words, num_threads=1)
        found = {w: self.word(w, a, b) for w, a, b in zip(words, a_ids, b_ids)}
        self.kept.update((w, f) for w, f in found.items() if len(w) <= KEPT_CHARS)
        return found

    def align(self, text: str):
        """The alignment of a space and a whole text that is not empty, or None."""
        if text[0] == " " or ODD_SPACE.search(text):
            words = CUT.split(" " + text)
            words[0] = words[0][1:]
        else:
            words = text.split(" ")
        kept = self.kept
        try:
            found = [kept[w] for w in words]
        except KeyError:
            new = self.learn([w for w in dict.fromkeys(words) if w not in kept])
            kept = self.kept
            found = [kept[w] if w in kept else new[w] if w in new else self.learn([w])[w] for w in words]
        if None in found:
            return None
        groups, a, b, exact, others = zip(*found)
        return ";".join(groups), sum(a), sum(b), b"".join(exact), b"".join(others)


_ALIGNERS: dict = {}


def aligner(a: str, b: str) -> PairAligner:
    """One aligner per process and pair of vocabularies."""
    if (a, b) not in _ALIGNERS:
        _ALIGNERS[a, b] = PairAligner(a, b)
    return _ALIGNERS[a, b]


ROW = pa.schema([("row", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()),
                 ("exact", pa.binary()), ("others", pa.binary())])


def align_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model",
                digest: bool = False) -> DataFrame:
    """One row per input row: the identifier, `row`, n_a, n_b, n_groups, `groups`, `exact`, `others`.

    groups: `a1,a2|b1;a3|b2,b3`, or with `digest` its sha256. exact: A ids of the groups of one token each with the same bytes and
    the mapped B id, as unsigned 32-bit integers. others: a * (size of B) + b for the last tokens of each other group, as 64-bit
    integers. Null and empty texts, and texts that one of the tokenizers does not keep byte for byte, have no tokens: zeros and
    empty values, no digest. `row` differs between all rows of one execution, so write the result before you use it twice. Null
    and repeated identifiers are kept, other columns not read; an empty table gives an empty one.
    """
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_l_text"))
    out = rows.select(id_col, *(F.lit(0).cast("bigint").alias(c) for c in ROW.names[:4]), F.lit("").alias("groups"),
                      F.lit(b"").alias("exact"), F.lit(b"").alias("others"))

    def aligned(batches):
        pair, number = aligner(a, b), TaskContext.get().partitionId() << 33
        for whole in batches:
            ids, made, size = 0, [], 0
            texts = whole.column(1).to_pylist()
            for at, text in enumerate(texts):
                found = pair.align(text) if text and SPACE not in text else None
                groups, n_a, n_b, exact, others = found or ("", 0, 0, b"", b"")
                count = groups.count(";") + 1 if groups else 0
                if digest and groups:
                    groups = hashlib.sha256(groups.encode()).hexdigest()
                made.append((number, n_a, n_b, count, groups, exact, others))
                number += 1
                size += len(groups) + len(exact) + len(others)
                if size > FLUSH_BYTES or at == len(texts) - 1:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*made), ROW)]
                    yield pa.RecordBatch.from_arrays([whole.column(0).slice(ids, len(made)), *columns], names=[id_col, *ROW.names])
                    ids, made, size = at + 1, [], 0

    return rows.mapInArrow(aligned, out.schema)


def pair_counts(aligned: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """pair (a_id * size of B + b_id), a_id, b_id, n: in how many links of all texts the two tokens end together; `best` says
    whether no other A id has more links with the B id. The table has at most as many rows as there are pairs of ids.
    """
    def counted(batches):
        pair = aligner(a, b)
        exact, keys, numbers, held = np.zeros(pair.a_size, np.int64), [], [], 0

        def summed():
            unique, place = np.unique(np.concatenate(keys), return_inverse=True)
            return unique, np.bincount(place, weights=np.concatenate(numbers)).astype(np.int64)

        for whole in batches:
            for ids in whole.column(0).to_pylist():
                if ids:
                    exact += np.bincount(np.frombuffer(ids, np.uint32), minlength=len(exact))
            joined = b"".join(whole.column(1).to_pylist())
            if joined:
                unique, times = np.unique(np.frombuffer(joined, np.int64), return_counts=True)
                keys.append(unique)
                numbers.append(times)
                held += len(unique)
            if held > 2 * FLUSH_PAIRS:
                one, times = summed()
                if len(one) > FLUSH_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(times)], names=["pair", "n"])
                    one, times = one[:0], times[:0]
                keys, numbers, held = [one], [times], len(one)
        if held:
            one, times = summed()
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(times)], names=["pair", "n"])
        ids = np.flatnonzero(exact)
        yield pa.RecordBatch.from_arrays([pa.array(ids * pair.b_size + pair.same[ids], pa.int64()), pa.array(exact[ids])], names=["pair", "n"])

    size = aligner(a, b).b_size
    pairs = aligned.select("exact", "others").mapInArrow(counted, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = pairs.select("pair", F.expr(f"pair div {size}").alias("a_id"), F.expr(f"pair % {size}").alias("b_id"), "n")
    pairs = stored(pairs, "token-pairs")
    most = F.broadcast(pairs.groupBy(F.col("b_id").alias("_l_b")).agg(F.max("n").alias("_l_most")))     # at most B's vocabulary
    return pairs.join(most, F.col("b_id") == F.col("_l_b")).select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("_l_most")).alias("best"))


def linked_counts(aligned: DataFrame, counts: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model",
                  heavy: int = HEAVY) -> DataFrame:
    """The rows of a written `align_texts` with n_links, n_best (links whose pair is the best of its B id) and count_sum (of the
    pairs' counts over the links), for the written `counts` of the same texts. Texts without links get zeros.

    Broadcast are a vector of A's vocabulary and fewer than `heavy` pairs; every other pair's count is joined.
    """
    pair = aligner(a, b)
    exact_n, exact_best = np.zeros(pair.a_size, np.int64), np.zeros(pair.a_size, np.int64)
    total = counts.agg(F.sum("n")).first()[0] or 0
    mapped = aligned.sparkSession.createDataFrame([(i, m) for i, m in enumerate(pair.same.tolist()) if m >= 0], "a_id bigint, b_id bigint")
    for r in counts.join(F.broadcast(mapped), ["a_id", "b_id"], "left_semi").toLocalIterator():           # at most A's vocabulary
        exact_n[r["a_id"]], exact_best[r["a_id"]] = r["n"], r["best"]
    often = F.col("n") > total // heavy
    frequent = sorted((r["pair"], r["n"], r["best"]) for r in counts.where(often).select("pair", "n", "best").toLocalIterator())
    tables = aligned.sparkSession.sparkContext.broadcast(
        (exact_n, exact_best, *(np.array([f[k] for f in frequent], np.int64) for k in range(3))))
    names = [c for c in aligned.columns if c not in ("exact", "others")]
    rows = aligned.select(*names, "exact", "others")
    numbers_of = ("n_links", "n_best", "count_sum", "_l_pair", "_l_times")
    shape = rows.select(*names, *(F.lit(None).cast("bigint").alias(c) for c in numbers_of))
    columns = shape.columns

    def known(batches):
        of_a, best_of_a, keys, numbers, best = tables.value
        for whole in batches:
            sums, doc, rest, times = [], [], [], []
            for at, (ids, others) in enumerate(zip(whole.column(len(names)).to_pylist(), whole.column(len(names) + 1).to_pylist())):
                ids, others = np.frombuffer(ids, np.uint32), np.frombuffer(others, np.int64)
                n_best, total_n = int(best_of_a[ids].sum()), int(of_a[ids].sum())
                if len(others) and len(keys):
                    place = np.minimum(np.searchsorted(keys, others), len(keys) - 1)
                    hit = keys[place] == others
                    n_best += int(best[place[hit]].sum())
                    total_n += int(numbers[place[hit]].sum())
                    left = others[~hit]
                else:
                    left = others
                sums.append((len(ids) + len(others), n_best, total_n))
                if len(left):
                    unique, count = np.unique(left, return_counts=True)
                    doc.append(np.full(len(unique), at))
                    rest.append(unique)
                    times.append(count)
            number = whole.column(names.index("row"))
            # no pair: a key of its own, so that the rows spread over the join
            base = [*whole.columns[:len(names)], *(pa.array(c, pa.int64()) for c in zip(*sums)),
                    pa.array(-1 - number.to_numpy(zero_copy_only=False)), pa.array(np.zeros(len(whole), np.int64))]
            yield pa.RecordBatch.from_arrays(base, names=columns)
            if doc:
                doc, rest, times = np.concatenate(doc), np.concatenate(rest), np.concatenate(times).astype(np.int64)
                for low in range(0, len(doc), 100_000):
                    part = slice(low, low + 100_000)
                    size = len(doc[part])
                    blank = [pa.nulls(size, whole.column(k).type) if n != "row" else number.take(pa.array(doc[part])) for k, n in enumerate(names)]
                    yield pa.RecordBatch.from_arrays([*blank, *[pa.nulls(size, pa.int64())] * 3, pa.array(rest[part]), pa.array(times[part])],
                                                     names=columns)

    seen = rows.mapInArrow(known, shape.schema)
    rare = counts.where(~often).select(F.col("pair").alias("_l_pair"), F.col("n").alias("_l_n"), F.col("best").alias("_l_best"))
    joined = seen.join(rare, "_l_pair", "left")
    added = {"n_best": F.col("_l_times") * F.col("_l_best").cast("bigint"), "count_sum": F.col("_l_times") * F.col("_l_n")}
    keep = [F.max(c).alias(c) for c in (*names, "n_links") if c != "row"]
    sums = [F.sum(F.coalesce(c, F.lit(0)) + F.coalesce(more, F.lit(0))).cast("bigint").alias(c) for c, more in added.items()]
    return joined.groupBy("row").agg(*keep, *sums).select(*names, "n_links", "n_best", "count_sum")


def alignment_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: the identifier, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, over all texts of the table."""
    aligned = stored(align_texts(df, id_col, text_col, digest=True), "aligned")
    counts = stored(pair_counts(aligned), "pair-counts")
    found = linked_counts(aligned, counts)
    return found.select(id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
