"""Fill-in-middle transformation by displacement scatter.

Spark's expressions choose form and cuts from a hash of the identifier. A block of texts then is one byte array: a scan over the
code points finds the bytes of the cuts, a difference array holds at each segment's first byte by how much the output shift
changes there, its running sum is the shift of every byte, and one scatter writes the output. The inverse finds the marks in the
output, sets up the difference array over the places of the restored text, and gathers. All arrays beside input and output are
made for one window of bytes at a time, so very long texts need no more of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
WINDOW = 1 << 20
BLOCK_BYTES = 16 << 20
SEED, PLAIN_FROM, SPM_BELOW = "1", 90, 20


def planned(df: DataFrame, id_col: str, text_col: str, seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """The identifier with text, n (code points), form, prefix_chars and middle_chars, the last two null for plain texts.

    The four numbers are the first 8-digit groups of the hex sha256 of `seed:identifier`; a null identifier hashes as empty.
    """
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_f_text"), digest.alias("_f_hash"))

    def number(k: int) -> Column:
        return F.conv(F.substring("_f_hash", 1 + 8 * k, 8), 16, 10).cast("bigint")

    rows = rows.withColumn("_f_n", F.length("_f_text").cast("bigint"))
    one, other = (number(k) % (F.col("_f_n") + 1) for k in (0, 1))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("_f_text", F.lit(mark.decode()))
    form = F.when((F.col("_f_n") == 0) | marked | (number(2) % 100 >= plain_from), "plain").when(number(3) % 100 < spm_below, "spm").otherwise("psm")
    rows = rows.withColumn("_f_form", form)
    cut = F.col("_f_form") != "plain"
    return rows.select(id_col, "_f_text", F.col("_f_n").alias("n"), F.col("_f_form").alias("form"),
                       F.when(cut, F.least(one, other)).alias("prefix_chars"), F.when(cut, F.abs(one - other)).alias("middle_chars"))


def text_bytes(texts: pa.Array) -> tuple:
    """The bytes of a string array without nulls, and where each text begins and ends in them."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])


def char_places(data: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The byte at which the code point of each rank (ascending) begins; the number of code points stands for the end."""
    places, seen, done = np.full(len(ranks), len(data), np.int64), 0, 0
    for low in range(0, len(data), WINDOW):
        first = np.flatnonzero((data[low:low + WINDOW] & 0xC0) != 0x80)
        upto = np.searchsorted(ranks, seen + len(first))
        places[done:upto] = low + first[ranks[done:upto] - seen]
        seen, done = seen + len(first), upto
    return places


def shifts(places: np.ndarray, shift: np.ndarray, size: int):
    """(first, last + 1, shift of each byte) window by window: the running sum of a difference array that is zero but at the
    first bytes of the segments, given in order; segments without bytes cancel out."""
    change = np.diff(shift, prepend=0)
    carried = done = 0
    for low in range(0, size, WINDOW):
        high = min(low + WINDOW, size)
        upto = np.searchsorted(places, high)
        difference = np.zeros(high - low, np.int64)
        np.add.at(difference, places[done:upto] - low, change[done:upto])
        difference[0] += carried
        moved = np.cumsum(difference)
        yield low, high, moved
        carried, done = moved[-1], upto


def scatter(data, at, form, prefix_chars, middle_chars, n) -> tuple:
    """The output bytes of a block of texts and where each output begins and ends. form: 0 plain, 1 psm, 2 spm."""
    cut = form > 0
    rank = np.concatenate(([0], np.cumsum(n)))[:-1]
    ranks = np.stack([rank + prefix_chars, rank + prefix_chars + middle_chars], 1)[cut].ravel()
    cuts = np.repeat(at[1:], 2).reshape(-1, 2)                  # plain: one segment, two empty ones behind it
    cuts[cut] = char_places(data, ranks).reshape(-1, 2)
    begin = np.concatenate([at[:-1, None], cuts], 1)            # first bytes of prefix, middle and suffix
    size = np.diff(begin, axis=1, append=at[1:, None])
    out_at = at + MARK * 3 * np.concatenate(([0], np.cumsum(cut)))
    start = out_at[:-1]
    pre, mid, suf = size.T
    spm = form == 2
    to = np.stack([start + np.where(spm, 2 * MARK + suf, MARK), start + 3 * MARK + pre + suf, start + np.where(spm, MARK, 2 * MARK + pre)], 1)
    to[~cut] = (start[:, None] + begin - at[:-1, None])[~cut]
    out = np.empty(out_at[-1], np.uint8)
    for low, high, moved in shifts(begin.ravel(), (to - begin).ravel(), len(data)):
        out[np.arange(low, high) + moved] = data[low:high]
    for place, mark in zip(to.T, (PREFIX, MIDDLE, SUFFIX)):
        for k, byte in enumerate(mark):
            out[place[cut] - MARK + k] = byte
    return out, out_at


def mark_places(data: np.ndarray) -> np.ndarray:
    """Where `<P>`, `<S>` or `<M>` begins, in order."""
    found = []
    for low in range(0, len(data) - MARK + 1, WINDOW):
        part = data[low:low + WINDOW + MARK - 1]
        hit = np.flatnonzero((part[:-2] == PREFIX[0]) & (part[2:] == PREFIX[2]))
        inner = part[hit + 1]
        found.append(low + hit[(inner == PREFIX[1]) | (inner == SUFFIX[1]) | (inner == MIDDLE[1])])
    return np.concatenate(found) if found else np.empty(0, np.int64)


def gather(data, at, form) -> tuple:
    """The texts that a block of outputs was made from, told by form and marks alone."""
    cut = form > 0
    marks = mark_places(data)
    doc = np.searchsorted(at, marks, "right") - 1
    inside = (marks + MARK <= at[np.minimum(doc + 1, len(at) - 1)]) & cut[np.minimum(doc, len(form) - 1)] if len(marks) else np.empty(0, bool)
    marks = marks[inside]
    spm, end = (form == 2)[cut], at[1:][cut]
    order = np.where(spm[:, None], np.frombuffer(SUFFIX[1:2] + PREFIX[1:2] + MIDDLE[1:2], np.uint8),
                     np.frombuffer(PREFIX[1:2] + SUFFIX[1:2] + MIDDLE[1:2], np.uint8))
    if not np.array_equal(np.repeat(np.flatnonzero(cut), 3), doc[inside]) or not np.array_equal(data[marks + 1], order.ravel()) \
            or not np.array_equal(marks[::3], at[:-1][cut]):
        raise ValueError("an output that is not plain begins with a mark and has exactly one of each kind, the middle's last")
    marks = marks.reshape(-1, 3)
    first, second = marks[:, 1] - marks[:, 0] - MARK, marks[:, 2] - marks[:, 1] - MARK
    sizes = np.stack([np.where(spm, second, first), end - marks[:, 2] - MARK, np.where(spm, first, second)], 1)
    source = np.stack([np.where(spm, marks[:, 1], marks[:, 0]), marks[:, 2], np.where(spm, marks[:, 0], marks[:, 1])], 1) + MARK
    text_at = at - MARK * 3 * np.concatenate(([0], np.cumsum(cut)))
    begin = np.repeat(text_at[:-1], 3).reshape(-1, 3)
    begin[cut, 1:] += np.cumsum(sizes, 1)[:, :2]
    begin[~cut, 1:] = text_at[1:][~cut, None]
    origin = np.repeat(at[:-1], 3).reshape(-1, 3) + begin - text_at[:-1, None]
    origin[cut] = source
    text = np.empty(text_at[-1], np.uint8)
    for low, high, moved in shifts(begin.ravel(), (origin - begin).ravel(), len(text)):
        text[low:high] = data[np.arange(low, high) + moved]
    return text, text_at


def blocks(batch: pa.RecordBatch, column: int):
    """Slices of a batch with at most BLOCK_BYTES of text each, or one longer text."""
    _, at = text_bytes(batch.column(column))
    low = 0
    while low < len(batch):
        high = max(int(np.searchsorted(at, at[low] + BLOCK_BYTES, "right")) - 1, low + 1)
        yield batch.slice(low, high - low)
        low = high


def form_codes(forms: pa.Array) -> np.ndarray:
    return np.array([("plain", "psm", "spm").index(f) for f in forms.to_pylist()], np.int64)


def whole_numbers(values: pa.Array) -> np.ndarray:
    return values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def transformed_block(b: pa.RecordBatch) -> tuple:
    data, at = text_bytes(b.column(1))
    return scatter(data, at, form_codes(b.column(3)), whole_numbers(b.column(4)), whole_numbers(b.column(5)), whole_numbers(b.column(2)))


def digests(data: np.ndarray, at: np.ndarray) -> list:
    view, ends = memoryview(data), at.tolist()
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]


def fim_transform(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, plain_from: int = PLAIN_FROM,
                  spm_below: int = SPM_BELOW) -> DataFrame:
    """One row per input row: the identifier, n, form, prefix_chars, middle_chars and `output`.

    psm: `<P>`prefix`<S>`suffix`<M>`middle; spm: `<S>`suffix`<P>`prefix`<M>`middle; plain: the text. Null and empty texts, texts
    that contain a mark, and those whose third number modulo 100 is `plain_from` or more, are plain with null cuts. Prefix,
    middle and suffix may be empty. Equal rows, also with a null identifier, get equal cuts. Other columns are not read, whatever
    they are called; an empty table gives an empty one.
    """
    rows = planned(df, id_col, text_col, seed, plain_from, spm_below)
    out = rows.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.lit("").alias("output"))
    names = out.columns

    def transformed(batches):
        for whole in batches:
            for b in blocks(whole, 1):
                output = strings(*transformed_block(b)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], output], names=names)

    return rows.mapInArrow(transformed, out.schema)


def fim_restore(df: DataFrame, id_col: str = "doc_id", output_col: str = "output", form_col: str = "form") -> DataFrame:
    """One row per input row: the identifier and the `text` that the output was made from; a null output gives null.

    An output that is not plain and lacks one of the three marks, or has one twice, fails the job.
    """
    rows = df.select(F.col(id_col), F.coalesce(F.col(output_col), F.lit("")).alias("_f_output"),
                     F.when(F.col(output_col).isNull(), "plain").otherwise(F.col(form_col)).alias("_f_form"), F.col(output_col).isNull().alias("_f_null"))

    def restored(batches):
        for whole in batches:
            for b in blocks(whole, 1):
                text = strings(*gather(*text_bytes(b.column(1)), form_codes(b.column(2)))).cast(pa.string())
                text = pa.compute.if_else(b.column(3), pa.scalar(None, pa.string()), text)
                yield pa.RecordBatch.from_arrays([b.column(0), text], names=[id_col, "text"])

    return rows.mapInArrow(restored, rows.select(id_col, F.lit(None).cast("string").alias("text")).schema)


def fim_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Transform and restore every text and return the digests of output and restored text; neither leaves the worker.

    Rows, nulls and other columns as in fim_transform.
    """
    rows = planned(df, id_col, text_col)
    out = rows.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.lit("").alias("output_sha256"), F.lit("").alias("restored_sha256"))
    names = out.columns

    def digested(batches):
        for whole in batches:
            for b in blocks(whole, 1):
                output, at = transformed_block(b)
                text, text_at = gather(output, at, form_codes(b.column(3)))
                yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(digests(output, at), pa.string()),
                                                  pa.array(digests(text, text_at), pa.string())], names=names)

    return rows.mapInArrow(digested, out.schema)
