"""N-gram scoring with a log-frequency Bloom filter.

Counts of one- and two-token sequences are quantised to powers of two, and a sequence of level q is entered into one Bloom
filter as (sequence, 1) to (sequence, q). A level is read back by probing 1, 2, ... until a probe fails. The filter is cut
into blocks; all entries of a sequence lie in its block, so one task builds a block from its rows alone and only finished
blocks reach the driver, which broadcasts them. How many entries there will be follows from the counts of the sequences whose
hash falls into 1/SHARE of the range, taken over the whole corpus. A filter that would need over MAX_BITS is not gathered: texts
are dealt into chunks, the different sequences of a chunk travel to the tasks that build their blocks, are read there, and only
their levels travel back to the chunk. No sequence is left out, and a reading is the same either way.

Beside the model stands an exact base score from single-token counts. The most frequent tokens (at most HEAD) travel as a
broadcast table; occurrences of all others are joined with the count table.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import stored

MAX_BITS, LEAST_BITS, BLOCKS = 1 << 29, 1 << 20, 4096
BITS_PER_ENTRY, PROBES = 7, 4
LEVELS = 40
HEAD = 1 << 17
SHARE = 256
CHUNK_TOKENS = 1 << 21
#: Tokens scored at once: a dozen arrays of this length are held beside the filter.
SCORE_TOKENS = 1 << 17
#: A chunk of texts whose sequences are read from a filter that is not broadcast; bytes, and texts if they are short.
CHUNK_BYTES, CHUNK_TEXTS = 4 << 20, 1 << 16
#: Sequences of all chunks that meet in one task, and the largest block; more of them make more groups and more blocks.
GROUP_KEYS, BLOCK_BITS = 1 << 22, 1 << 20
#: Smoothing: the share of a context's count that seen pairs give up, and how the kinds of pairs grow with its count.
DISCOUNT, KINDS_POWER = 0.75, 0.85
END = xxhash.xxh64_intdigest(b"")
START = 0x9E3779B97F4A7C15
_A, _B, _C = (np.uint64(c) for c in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def text_tokens(text: bytes) -> np.ndarray:
    """64-bit hashes of the lower-cased (A-Z) tokens between ASCII white space, and the end."""
    words = text.lower().split()
    return np.fromiter((*map(xxhash.xxh64_intdigest, words), END), np.uint64, len(words) + 1)


def contexts(tokens: np.ndarray, lengths) -> np.ndarray:
    """The token before each one; START before the first of a text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)] = START
    return before


def single_keys(tokens: np.ndarray) -> np.ndarray:
    return mixed(tokens ^ _C)


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mixed(mixed(before + _C) * _B + tokens)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, 2 for 2 and 3, 3 for 4 to 7, and so on."""
    return np.minimum(np.frexp(counts.astype(np.float64))[1], LEVELS)


def typical_count(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the geometric middle of its range, 0 for level 0."""
    low = np.exp2(levels.astype(np.float64) - 1)
    return np.where(levels == 0, 0.0, np.sqrt(low * np.maximum(low * 2 - 1, 1)))


def bit_places(keys: np.ndarray, level, block_bits: int) -> list:
    """Places inside the key's block of its PROBES bits at a level."""
    a = mixed(keys + np.uint64(level * int(_A) & (1 << 64) - 1))
    step = mixed(a ^ _B) | np.uint64(1)
    return [((a + np.uint64(i) * step) & np.uint64(block_bits - 1)).astype(np.int64) for i in range(PROBES)]


class LogFrequencyFilter:
    """A finished filter, or the part of it from block `first` on: bytes of its blocks in a row. `blocks`: of the whole filter."""

    def __init__(self, data: np.ndarray, block_bits: int, blocks: int = BLOCKS, first: int = 0):
        self.data, self.block_bits, self.blocks, self.first = data, block_bits, blocks, first

    def read_levels(self, keys: np.ndarray) -> np.ndarray:
        out, active = np.zeros(len(keys), np.int64), np.arange(len(keys))
        base = ((keys % np.uint64(self.blocks)).astype(np.int64) - self.first) * (self.block_bits // 8)
        for level in range(1, LEVELS + 1):
            if not len(active):
                break
            k, at = keys[active], base[active]
            hit = np.ones(len(active), bool)
            for place in bit_places(k, level, self.block_bits):
                hit &= (self.data[at + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 == 1
            active = active[hit]
            out[active] = level
        return out


class ReadLevels:
    """Levels read elsewhere, for sorted keys as `by_block` gives them."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray, blocks: int):
        self.keys, self.levels, self.blocks = keys, levels, blocks

    def read_levels(self, keys: np.ndarray) -> np.ndarray:
        return self.levels[np.searchsorted(self.keys, by_block(keys, self.blocks))].astype(np.int64)


def by_block(keys: np.ndarray, blocks: int) -> np.ndarray:
    """The key turned so that the number of its block (its lowest bits) comes first."""
    shift = np.uint64(blocks.bit_length() - 1)
    return (keys >> shift) | (keys << (np.uint64(64) - shift))


def from_block(turned: np.ndarray, blocks: int) -> np.ndarray:
    shift = np.uint64(blocks.bit_length() - 1)
    return (turned << shift) | (turned >> (np.uint64(64) - shift))


def packed(numbers: np.ndarray) -> tuple[int, bytes]:
    """(bytes per number, the numbers): as many bytes each as the largest needs."""
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8)
    return width, np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked(width: int, data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.uint64, copy=False)


def build_blocks(keys: np.ndarray, counts: np.ndarray, block_bits: int, n_blocks: int = BLOCKS) -> dict:
    """block -> its bytes, for all blocks that the keys fall into."""
    made: dict = {}
    blocks, top = (keys % np.uint64(n_blocks)).astype(np.int64), levels_of(counts)
    order = np.argsort(blocks, kind="stable")
    keys, top, blocks = keys[order], top[order], blocks[order]
    found, starts = np.unique(blocks, return_index=True)
    for b, lo, hi in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(blocks)]):
        bits = np.zeros(block_bits, bool)
        k, t = keys[lo:hi], top[lo:hi]
        for level in range(1, int(t.max()) + 1):
            k, t = k[t >= level], t[t >= level]
            for place in bit_places(k, level, block_bits):
                bits[place] = True
        made[b] = np.packbits(bits, bitorder="little").tobytes()
    return made


def ngram_counts(texts: DataFrame, pairs: bool) -> DataFrame:
    """kind (0: one token, 1: pair), key, n. `pairs`: all pairs and mixed single keys, else single tokens and 1/SHARE of the pairs.

    Counted chunk by chunk where the texts are, so that the shuffle gets one row per key and chunk.
    """
    def count(batches):
        held, lengths, total = [], [], 0

        def rows():
            tokens = np.concatenate(held)
            pair = pair_keys(contexts(tokens, lengths), tokens)
            single = single_keys(tokens) if pairs else tokens
            for kind, keys in ((0, single), (1, pair if pairs else pair[pair % np.uint64(SHARE) == 0])):
                u, n = np.unique(keys, return_counts=True)
                for i in range(0, len(u), 1 << 17):
                    part = u[i:i + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part.view(np.int64)), pa.array(n[i:i + (1 << 17)])],
                                                     names=["kind", "key", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                held.append(text_tokens(text or b""))
                lengths.append(len(held[-1]))
                total += lengths[-1]
                if total >= CHUNK_TOKENS:
                    yield from rows()
                    held, lengths, total = [], [], 0
        if held:
            yield from rows()

    return texts.mapInArrow(count, "kind int, key bigint, n bigint")


class BloomLm:
    """What scoring needs: the filter, the totals, and the head of the single-token counts."""

    def __init__(self, filter_, n: int, v: int, head_keys: np.ndarray, head_counts: np.ndarray):
        order = np.argsort(head_keys)
        self.filter, self.n, self.v = filter_, n, v
        self.head_keys, self.head_counts = head_keys[order], head_counts[order]
        self.texts, self.bits = None, 0                           # of a filter that is too large to gather: what it is built from

    def reading(self, filter_) -> "BloomLm":
        """The model with this filter in place of its own, and nothing that cannot leave the driver."""
        out = copy.copy(self)
        out.filter, out.texts = filter_, None
        return out

    def base_logs(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1.0) / (self.n + self.v + 1.0))

    def score_tokens(self, tokens: np.ndarray, lengths) -> tuple:
        """Per token: log10 of the smoothed probability, head count (-1: not in the head)."""
        unique, inverse = np.unique(tokens, return_inverse=True)
        head = np.full(len(unique), -1, np.int64)
        if len(self.head_keys):
            at = np.minimum(np.searchsorted(self.head_keys, unique), len(self.head_keys) - 1)
            same = self.head_keys[at] == unique
            head[same] = self.head_counts[at[same]]
        single = typical_count(self.filter.read_levels(single_keys(unique)))[inverse]
        context = np.empty_like(single)                       # how often the context was seen
        context[1:] = single[:-1]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        context[starts] = max(1.0, typical_count(self.filter.read_levels(single_keys(np.array([END], np.uint64))))[0])
        pair = np.minimum(typical_count(self.filter.read_levels(pair_keys(contexts(tokens, lengths), tokens))), context)
        lone = np.minimum((single + 1.0) / (self.n + self.v + 1.0), 1.0)
        kinds = np.minimum(DISCOUNT * np.power(np.maximum(context, 1), KINDS_POWER) / np.maximum(context, 1), 1.0)
        p = np.where(context > 0, np.maximum(pair - DISCOUNT, 0) / np.maximum(context, 1) + kinds * lone, lone)
        return np.log10(np.minimum(p, 1.0)) if self.n else np.zeros(len(tokens)), head[inverse]


def train(texts: DataFrame) -> tuple[BloomLm, DataFrame]:
    """The model, and the exact single-token counts (key, n), from the binary column of `texts`."""
    spark = texts.sparkSession
    first = stored(ngram_counts(texts, False).groupBy("kind", "key").agg(F.sum("n").alias("n")), "token-counts")
    singles = first.where("kind = 0").select("key", "n")
    n, v = singles.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    level = F.least(F.floor(F.log2("n")) + 1, F.lit(LEVELS)).cast("int")
    entries = np.zeros(LEVELS + 1)                            # entries of all sequences of each level
    for r in first.groupBy("kind", level.alias("level")).count().collect():
        entries[r["level"]] += r["count"] * r["level"] * (SHARE if r["kind"] else 1)
    bits, wanted = LEAST_BITS, entries.sum() * BITS_PER_ENTRY
    while bits < wanted:
        bits *= 2
    gathered = wanted <= MAX_BITS
    filter_ = LogFrequencyFilter(filter_bytes(ngram_counts(texts, True), bits // BLOCKS), bits // BLOCKS) if gathered else None
    head = singles.orderBy(F.desc("n"), "key").limit(HEAD).toPandas()
    model = BloomLm(filter_, int(n), int(v), head["key"].to_numpy(np.int64).view(np.uint64), head["n"].to_numpy(np.int64))
    model.texts, model.bits = (None if gathered else texts), bits
    return model, singles


def filter_bytes(counts: DataFrame, block_bits: int) -> np.ndarray:
    """Build the blocks where their sequences meet and lay them in a row; at most MAX_BITS come together."""
    block = F.col("key").bitwiseAND(F.lit(BLOCKS - 1)).alias("block")
    summed = counts.select(block, "key", "n").repartition("block").groupBy("block", "key").agg(F.sum("n").alias("n"))

    def build(batches):
        keys, counts = [], []
        for b in batches:
            keys.append(b.column(1).to_numpy())
            counts.append(b.column(2).to_numpy())
        if keys:
            made = build_blocks(np.concatenate(keys).view(np.uint64), np.concatenate(counts), block_bits)
            for number, data in made.items():
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([data], pa.binary())], names=["number", "data"])

    out = np.zeros(BLOCKS * block_bits // 8, np.uint8)
    for row in summed.mapInArrow(build, "number bigint, data binary").toLocalIterator():
        at = row["number"] * block_bits // 8
        out[at:at + block_bits // 8] = np.frombuffer(row["data"], np.uint8)
    return out


SCORED = "row bigint, n_tokens bigint, head_known bigint, head_score double, score double, tail array<bigint>"


def in_chunks(rows: DataFrame, sign: int = 1) -> DataFrame:
    """The rows, stored with the number of the chunk that each belongs to (`_m_chunk`)."""
    schema = rows.select("*", F.lit(None).cast("bigint").alias("_m_chunk")).schema
    at = rows.columns.index("_m_text")

    def number(batches):
        chunk, held, texts = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            numbers = []
            for n in pc.binary_length(b.column(at)).to_pylist():
                if held >= CHUNK_BYTES or texts >= CHUNK_TEXTS:
                    chunk, held, texts = chunk + 1, 0, 0
                numbers.append(sign * (chunk + 1))
                held, texts = held + n, texts + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int64())], names=schema.names)

    return stored(rows.mapInArrow(number, schema), "chunks")


def chunk_keys(tokens: np.ndarray, lengths, blocks: int) -> tuple:
    """(all different sequences of a chunk, turned by block and sorted; where each of its single tokens, then of its pairs, is)"""
    keys = np.concatenate([single_keys(tokens), pair_keys(contexts(tokens, lengths), tokens)])
    return np.unique(by_block(keys, blocks), return_inverse=True)


def routed_levels(chunks: DataFrame, bits: int) -> tuple[DataFrame, int]:
    """(per chunk and group of blocks the levels of the chunk's sequences in `chunk_keys` order, the number of blocks).

    `chunks`: rows of `in_chunks` with `_m_learn`. Per chunk and group one row travels with the different sequences and how often
    they are to be learned; the task of a group adds the counts up, builds the group's blocks of the filter and reads them.
    """
    blocks = max(BLOCKS, bits // BLOCK_BITS)
    block_bits = bits // blocks
    held = chunks.agg(F.sum(F.length("_m_text"))).first()[0] or 0
    group_bits = min(max(1, int(held // 3 // GROUP_KEYS).bit_length()), blocks.bit_length() - 1)
    shift = np.uint64(64 - group_bits)
    key_names = ["group", "chunk", "key_width", "keys", "count_width", "counts"]

    def send(table):
        held = [text_tokens(t) for t in table.column("_m_text").to_pylist()]
        lengths, tokens = np.array([len(h) for h in held]), np.concatenate(held)
        keys, inverse = chunk_keys(tokens, lengths, blocks)
        learned = np.repeat(table.column("_m_learn").to_numpy(zero_copy_only=False).astype(bool), lengths)
        counts = np.bincount(inverse[np.concatenate([learned, learned])], minlength=len(keys))
        found, starts = np.unique(keys >> shift, return_index=True)
        rows = []
        for g, lo, hi in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)]):
            steps = np.diff(keys[lo:hi], prepend=np.uint64(g) << shift)
            rows.append((g, table.column("_m_chunk")[0].as_py(), *packed(steps), *packed(counts[lo:hi])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary()))], names=key_names)

    def read(table):
        rows = table.to_pylist()
        first = np.uint64(rows[0]["group"]) << shift
        keys = [first + np.cumsum(unpacked(r["key_width"], r["keys"]), dtype=np.uint64) for r in rows]
        ends = np.cumsum([len(k) for k in keys])
        different, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.zeros(len(different), np.int64)
        for r, end, k in zip(rows, ends, keys):
            counts[inverse[end - len(k):end]] += unpacked(r["count_width"], r["counts"]).astype(np.int64)
        plain, seen = from_block(different, blocks), counts > 0
        n_blocks = blocks >> group_bits
        first_block, data = rows[0]["group"] * n_blocks, np.zeros(n_blocks * block_bits // 8, np.uint8)
        for b, made in build_blocks(plain[seen], counts[seen], block_bits, blocks).items():
            at = (b - first_block) * block_bits // 8
            data[at:at + block_bits // 8] = np.frombuffer(made, np.uint8)
        levels = LogFrequencyFilter(data, block_bits, blocks, first_block).read_levels(plain).astype(np.uint8)[inverse]
        answers = [levels[end - len(k):end].tobytes() for end, k in zip(ends, keys)]
        return pa.table([pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([r["group"] for r in rows], pa.int32()), pa.array(answers, pa.binary())],
                        names=["_m_chunk", "group", "levels"])

    sent = chunks.select("_m_text", "_m_learn", "_m_chunk").groupBy("_m_chunk").applyInArrow(
        send, "group int, chunk bigint, key_width int, keys binary, count_width int, counts binary")
    return sent.groupBy("group").applyInArrow(read, "_m_chunk bigint, group int, levels binary"), blocks


def score_texts(df: DataFrame, model: BloomLm, singles: DataFrame, text_col: str = "text", learned=None) -> DataFrame:
    """The columns of `df` but the text, with n_tokens, n_known, train_tokens, base_score and score of every text.

    Null text counts as empty: one token, the end. Repeated rows are scored each by itself. With nothing learned every
    probability is 1 and all scores are 0. An empty table gives an empty result. `learned`: a condition that holds on just those rows
    of `df` that the model was trained on, if they are among them; then a filter that is too large to broadcast is built from the
    same chunks that are scored, which spares it a second shuffle of all sequences.
    """
    names = [c for c in df.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_m_text")
    rows = df.select(*[F.col(f"`{c}`") for c in names], text)
    out_names = [*names, *(f"_m_{c.split()[0]}" for c in SCORED.split(", "))]

    def scored_rows(model, columns, texts, row):
        at = 0
        while at < len(texts):
            held, total, first = [], 0, at
            while at < len(texts) and total < SCORE_TOKENS:
                held.append(text_tokens(texts[at].as_py()))
                total, at = total + len(held[-1]), at + 1
            lengths, tokens = np.array([len(h) for h in held]), np.concatenate(held)
            logs, head = model.score_tokens(tokens, lengths)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            known = np.add.reduceat((head > 0).astype(np.int64), starts)
            base = np.add.reduceat(np.where(head >= 0, model.base_logs(np.maximum(head, 0)), 0.0), starts)
            rest = head < 0
            offsets = np.concatenate([[0], np.cumsum(np.add.reduceat(rest.astype(np.int64), starts))])
            tail = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens[rest].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*[c.slice(first, at - first) for c in columns], pa.array(np.arange(row + first, row + at)),
                 pa.array(lengths), pa.array(known), pa.array(base), pa.array(np.add.reduceat(logs, starts)), tail], names=out_names)

    def score(batches):
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            yield from scored_rows(shared.value, b.columns[:len(names)], b.column(len(names)), row)
            row += b.num_rows

    def score_chunk(table, answers):
        table = table.combine_chunks()
        texts = table.column("_m_text").combine_chunks()
        held = [text_tokens(t) for t in texts.to_pylist()]
        keys, _ = chunk_keys(np.concatenate(held), [len(h) for h in held], blocks)
        order = np.argsort(answers.column("group").to_numpy())
        levels = answers.column("levels").to_pylist()
        read = ReadLevels(keys, np.frombuffer(b"".join(levels[i] for i in order), np.uint8), blocks)
        del held
        columns = [table.column(i).combine_chunks() for i in range(len(names))]
        number = table.column("_m_chunk")[0].as_py() - 1
        made = list(scored_rows(shared.value.reading(read), columns, texts, (number >> 32 << 40) + ((number & 0xFFFFFFFF) << 20)))
        return pa.Table.from_batches(made)

    schema = rows.select(*[F.col(f"`{c}`") for c in names], *[F.lit(None).cast(t).alias(f"_m_{n}") for n, t in (c.split(" ") for c in SCORED.split(", "))])
    shared = df.sparkSession.sparkContext.broadcast(model.reading(model.filter))
    if model.texts is None:
        scored = stored(rows.mapInArrow(score, schema.schema), "scored")
    else:
        learn = F.lit(False) if learned is None else F.coalesce(learned, F.lit(False))
        chunks = in_chunks(df.select(*[F.col(f"`{c}`") for c in names], text, learn.alias("_m_learn")))
        kept = chunks.select("_m_text", "_m_learn", "_m_chunk")
        if learned is None:
            given = F.coalesce(F.col(f"`{model.texts.columns[0]}`"), F.lit(b"")).alias("_m_text")
            kept = kept.union(in_chunks(model.texts.select(given, F.lit(True).alias("_m_learn")), -1))
        answers, blocks = routed_levels(kept, model.bits)
        scored = stored(chunks.groupBy("_m_chunk").cogroup(answers.where("_m_chunk > 0").groupBy("_m_chunk")).applyInArrow(score_chunk, schema.schema), "scored")
    total = float(model.n + model.v + 1)
    tail = scored.select("_m_row", F.explode("_m_tail").alias("key")).groupBy("_m_row", "key").agg(F.count(F.lit(1)).alias("times"))
    found = tail.join(singles, "key", "left").groupBy("_m_row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("_m_known"),
        F.sum(F.col("times") * F.log10((F.coalesce(F.col("n"), F.lit(0)) + 1.0) / F.lit(total))).alias("_m_tail_score"))
    zero = F.lit(0)
    return scored.join(found, "_m_row", "left").select(
        *[F.col(f"`{c}`") for c in names], F.col("_m_n_tokens").alias("n_tokens"),
        (F.col("_m_head_known") + F.coalesce("_m_known", zero)).alias("n_known"), F.lit(model.n).cast("bigint").alias("train_tokens"),
        (F.col("_m_head_score") + F.coalesce("_m_tail_score", F.lit(0.0))).alias("base_score"), F.col("_m_score").alias("score"))
