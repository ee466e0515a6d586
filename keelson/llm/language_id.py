"""Language identification by compression.

Per language, the words of a sample of its labelled texts become a zstandard raw-content dictionary. A text's words are cut
into blocks, every block is compressed with every dictionary, and the language with the smallest total wins. A margin between
the best and the second-best total that is too narrow rejects the text.

Letters are folded to lower case and all else to single spaces, and a dictionary's words are in the order of a hash: a
passage that documents of several languages share can then match word by word only, not as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

#: Bounds of what is learned: sampled texts of a language, bytes of its dictionary, bytes of all dictionaries.
SAMPLE_ROWS, DICTIONARY_BYTES, ALL_BYTES = 400, 112 << 10, 8 << 20
BLOCK_BYTES = 4_096
LEVEL = 6
#: A text of any length is rejected if the second-best total is larger by less than MARGIN of the best one.
MARGIN = 0.002
UNDETERMINED = "und"
WORD = regex.compile(r"\p{L}+")
RESULT = "struct<lang_pred: string, score: double, rejected: boolean>"


def thinned(df: DataFrame, keys, order: str, most: int, size: str) -> DataFrame:
    """The `most` rows with the smallest `order` (a 64-bit hash) of each key, which has `size` rows. A threshold that follows from
    the size leaves a few times that number before they are ranked, so no task gets all rows of a frequent key."""
    few = df.where(F.pmod(F.col(order), F.lit(1 << 30)) <= F.lit(float(4 * most << 30)) / F.col(size))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.pmod(F.col(order), F.lit(1 << 30)), order))
    return few.withColumn("_g_rank", rank).where(F.col("_g_rank") <= most).drop("_g_rank")


def training_words(df: DataFrame, text_col: str, lang_col: str, rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES,
                   all_bytes: int = ALL_BYTES) -> DataFrame:
    """lang, share (labelled rows), bytes (of the dictionary), order, word: words of a sample of every language's texts.

    Sampled are at most `rows` different texts of a language by a hash of the text, of their words as many by a hash as a
    dictionary holds. All languages have one; if they are many, each is smaller. Whole texts are read.
    """
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("_g_text"))
    keys = labelled.select("lang", F.xxhash64("_g_text").alias("_g_hash")).groupBy("lang", "_g_hash").agg(F.count(F.lit(1)).alias("_g_n"))
    shares = stored(keys.groupBy("lang").agg(F.sum("_g_n").alias("share"), F.count(F.lit(1)).alias("_g_size")), "languages")
    size = max(64, min(dictionary_bytes, all_bytes // max(1, shares.count())))
    chosen = stored(thinned(keys.join(shares, "lang"), ["lang"], "_g_hash", rows, "_g_size").select("lang", "_g_hash", "share"), "language-sample")
    texts = labelled.withColumn("_g_hash", F.xxhash64("_g_text")).join(chosen, ["lang", "_g_hash"]).dropDuplicates(["lang", "_g_hash"])
    schema = texts.select("lang", "share", F.lit(0).cast("bigint").alias("order"), F.lit("").alias("word"), F.lit(0).cast("bigint").alias("n")).schema
    names = schema.names

    def words(batches):
        for b in batches:
            for lang, text, share, number in zip(*(b.column(i).to_pylist() for i in range(4))):
                found = WORD.findall(text.lower())
                for at in range(0, len(found), 10_000):
                    part = found[at:at + 10_000]
                    hashes = [xxhash.xxh64_intdigest(f"{number} {at + i}") - (1 << 63) for i in range(len(part))]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([share] * len(part), pa.int64()), pa.array(hashes, pa.int64()),
                                                      pa.array(part), pa.array([len(found)] + [0] * (len(part) - 1) if not at else [0] * len(part), pa.int64())], names=names)

    every = stored(texts.select("lang", "_g_text", "share", "_g_hash").mapInArrow(words, schema), "language-words")
    counts = every.groupBy("lang").agg(F.sum("n").alias("_g_words"))
    kept = thinned(every.join(counts, "lang"), ["lang"], "order", size // 4, "_g_words")
    return kept.select("lang", "share", F.lit(size).alias("bytes"), "order", "word")


class CompressionClassifier:
    """The dictionaries of all languages, at most ALL_BYTES (64 a language at least)."""

    def __init__(self, samples: list):
        """`samples`: lang, share, bytes, order, word."""
        words, self.share, self.dictionaries = {}, {}, {}
        for lang, share, size, order, word in samples:
            words.setdefault(lang, []).append((order, word))
            self.share[lang] = share, size
        self.languages = sorted(words, key=lambda lang: (-self.share[lang][0], lang))
        for lang in self.languages:
            self.dictionaries[lang] = " ".join(w for _, w in sorted(words[lang])).encode()[-self.share[lang][1]:]

    def open(self) -> list:
        """One compressor per language; they live in a worker process."""
        made = []
        for lang in self.languages:
            d = zstandard.ZstdCompressionDict(self.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False))
        return made

    def classify(self, text, compressors: list, margin: float = MARGIN) -> dict:
        """The decision on one text. Equal totals go to the language with more labelled rows, and are rejected."""
        words = WORD.findall(text.lower()) if text and compressors else []
        if not words:
            return {"lang_pred": UNDETERMINED, "score": 0.0, "rejected": True}
        data = " ".join(words).encode()
        blocks = [data[i:i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in compressors]
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best, second = sizes[order[0]], sizes[order[1]] if len(order) > 1 else len(data) + 16 * len(blocks)
        gap = max(0.0, second / best - 1)
        return {"lang_pred": self.languages[order[0]], "score": gap / (gap + 0.02), "rejected": gap < margin}


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> CompressionClassifier:
    """Learn from the rows of `df` that have text and label; only the bounded sample of words reaches the driver.

    Equal texts of a language count once in the sample. Identifiers and other columns are not read. Without labelled rows
    nothing is learned: every text is then `und` and rejected.
    """
    return CompressionClassifier([tuple(r) for r in training_words(df, text_col, lang_col).collect()])


def identify(df: DataFrame, classifier: CompressionClassifier, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """All rows and columns of `df`, with `lang_pred`, `score` (0 to 1) and `rejected`, from whole texts alone.

    A text that is null, empty or has no letters, and any text if no language was learned, is `und` with score 0, rejected.
    Columns of the input that bear one of the three names are replaced. An empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(classifier)

    @F.arrow_udf(RESULT)
    def decide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classifier = shared.value
        compressors = classifier.open()
        for texts in batches:
            rows = [classifier.classify(t, compressors, margin) for t in texts.to_pylist()]
            yield pa.array(rows, pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]))

    rows = df.drop("lang_pred", "score", "rejected")
    plain = [F.col(f"`{c}`") for c in rows.columns]
    return rows.withColumn("_g_found", decide(F.col(text_col))).select(*plain, "_g_found.lang_pred", "_g_found.score", "_g_found.rejected")
