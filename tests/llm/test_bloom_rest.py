"""A filter too large to broadcast: every n-gram is still counted and read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import bloom_lm


@pytest.mark.parametrize("chunk_bytes, group_keys, block_bits", [(4 << 20, 1 << 22, 1 << 20), (300, 50, 64)])
def test_large_filters_leave_no_ngram_out(spark, monkeypatch, chunk_bytes, group_keys, block_bits):
    rng = random.Random(2)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    rows = [(i if i % 9 else None, i % 3 == 0, rng.choice([None, "", "one", " ".join(rng.choices(words, k=rng.randrange(1, 60)))])) for i in range(240)]
    rows += [(7, True, "copy of a text")] * 40
    df = spark.createDataFrame(rows, "doc_id bigint, held_out boolean, text string").repartition(4)
    train = df.where("NOT held_out").select(F.col("text").cast("binary"))
    result = lambda found: sorted(map(repr, (tuple(r[:5]) + (round(r[5], 6), round(r[6], 9)) for r in found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect())))
    model, singles = bloom_lm.train(train)
    want = result(bloom_lm.score_texts(df, model, singles))
    monkeypatch.setattr(bloom_lm, "MAX_BITS", 60)
    for name, value in (("CHUNK_BYTES", chunk_bytes), ("GROUP_KEYS", group_keys), ("HEAD", 20)):
        monkeypatch.setattr(bloom_lm, name, value)
    model, singles = bloom_lm.train(train)
    assert model.filter is None
    for learned in (~F.col("held_out"), None):
        assert result(bloom_lm.score_texts(df, model, singles, learned=learned)) == want
    monkeypatch.setattr(bloom_lm, "BLOCK_BITS", block_bits)                   # more blocks: other false positives, the same counts
    other = bloom_lm.score_texts(df, model, singles, learned=~F.col("held_out"))
    assert abs(other.agg(F.sum("score")).first()[0] - sum(float(w.rsplit(", ", 1)[1][:-1]) for w in want)) < 1


def test_keys_turn_and_pack_back():
    keys = np.random.default_rng(1).integers(0, 1 << 64, 1000, dtype=np.uint64)
    for blocks in (4096, 1 << 15):
        turned = bloom_lm.by_block(keys, blocks)
        assert (bloom_lm.from_block(turned, blocks) == keys).all()
        assert (turned >> np.uint64(64 - blocks.bit_length() + 1) == keys % np.uint64(blocks)).all()
    for numbers in (keys, keys >> np.uint64(30), np.zeros(3, np.uint64)):
        assert (bloom_lm.unpacked(*bloom_lm.packed(numbers)) == numbers).all()
