"""Language identification, license scan, n-gram scoring, chat rendering and search against brute force."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from keelson.llm import bloom_lm, chat, language_id, license_scan, topk

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_license_scan(spark, docs, empty):
    rng = random.Random(1)
    vocabulary = "under the mit license apache version 2 cc by nc and É9".split()
    rows = [(i, rng.choice(["", "X "]) + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(200)]
    rows += [(500, "Licensed under the Apache-License, VERSION 2.0"), (501, "permission is hereby granted, free of charge, to any person who is obtaining "
             "a copy of this software and associated documentation files"), (501, "cc by nc"), (502, "cc by nc"), (502, "cc by nc")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(docs.select("doc_id", "text"))
    want = Counter()
    for r in df.collect():
        w = WORD.findall((r.text or "").translate(ASCII_LOWER))
        at = [(i, label) for label, phrase in license_scan.PHRASES for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in at]
        want[(r.doc_id, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))] += 1
    got = license_scan.license_scan(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    inserted = next(r for r in got if r.doc_id == 501 and r.n_words > 5)       # two words more do not split the span
    assert inserted.labels == "mit" and inserted.base_labels == "" and inserted.score > 0.8
    assert license_scan.license_scan(empty).count() == 0


def brute_scan(text, merge_gap=3):
    """(labels by the method, best coverage): every pair of neighbouring diagonals, every place of the change."""
    w = [x for x in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    best, labels = 0.0, set()
    for base, (label, phrase) in [(True, p) for p in license_scan.PHRASES] + [(False, n) for n in license_scan.NOTICES]:
        p = phrase.split()
        grams = len(p) - 2
        on = {}
        for i in range(len(w) - 2):
            for t in range(grams):
                if w[i:i + 3] == p[t:t + 3]:
                    on.setdefault(i - t, set()).add(t)
        top = max(map(len, on.values()), default=0)
        for d1 in on:
            for d2 in on:
                if d1 != d2 and abs(d1 - d2) <= merge_gap:
                    for t in range(1, grams + 1):
                        top = max(top, sum(x < t for x in on[d1]) + sum(x >= t + max(0, d1 - d2) for x in on[d2]))
        best = max(best, top / grams)
        if top / grams >= 0.8 or base and any(len(x) == grams for x in on.values()):
            labels.add(label)
    return ",".join(sorted(labels)), best


def test_license_spans_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "BLOCK", 7)
    rng = random.Random(4)
    texts = []
    for _ in range(250):
        w = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(license_scan.PHRASES + license_scan.NOTICES)[1].split()
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(p))
                p[at:at + rng.randrange(3)] = [rng.choice(["the", "new", "license"])] * rng.randrange(4)
            if rng.random() < 0.2:                          # all grams there, but in another order: no span
                cut = len(p) // 2
                p = p[cut:] + p[:cut]
            w += p + ["x"] * rng.randrange(3)
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.labels, pytest.approx(r.score)) for r in license_scan.license_scan(df).collect()}
    want = {i: brute_scan(t) for i, t in enumerate(texts)}
    assert want == got and len({labels for labels, _ in want.values()}) > 10


def test_license_in_a_text_of_a_million_words(spark):
    df = spark.createDataFrame([(1, "cc by nc " * 333_334 + "under the MIT license")], "doc_id bigint, text string")
    start = time.time()
    r = license_scan.license_scan(df).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (1_000_006, 333_335, 0, 1_000_002, "cc-by-nc,mit")
    assert time.time() - start < 60


LANGS = {"aa": "ka lo mi tu re sa", "bb": "xor yth zen qwa plo", "cc": "école été où ça déjà"}


def labelled(spark, n=300):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        rows.append((i, " ".join(rng.choice(LANGS[lang].split()) + rng.choice(["", "s", ","]) for _ in range(rng.randrange(5, 80))), lang))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_language_id(spark, docs, empty):
    df = labelled(spark)
    classifier = language_id.train(df.where("doc_id % 4 <> 2"))
    got = language_id.identify(df, classifier).where("doc_id % 4 = 2").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) and all(0 <= r.score <= 1 for r in got)
    odd = language_id.identify(docs, classifier)
    assert odd.count() == docs.count() and odd.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score", "rejected"]
    for r in odd.collect():
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in LANGS
    assert language_id.identify(empty, classifier).count() == 0
    unlearned = language_id.identify(df, language_id.train(empty)).first()
    assert (unlearned.lang_pred, unlearned.rejected) == ("und", True)


def test_narrow_margins_are_rejected(spark):
    classifier = language_id.train(labelled(spark))
    compressors = classifier.open()
    mixed = " ".join(f"{a} {b}" for a, b in zip(LANGS["aa"].split() * 60, LANGS["bb"].split() * 72))
    assert classifier.classify(mixed, compressors, margin=0.5)["rejected"]
    tie = classifier.classify("ñ", compressors)             # no dictionary helps: short texts are rejected as well
    assert tie["rejected"] and tie["score"] == 0 and tie["lang_pred"] in LANGS
    assert not classifier.classify("ka lo mi tu re sa ka", compressors)["rejected"]


def test_numerals_are_no_letters(spark):
    classifier = language_id.train(labelled(spark))
    for text in ("½ ² ①", "12 _ 3", "٣ Ⅷ", ""):
        assert classifier.classify(text, classifier.open()) == {"lang_pred": "und", "score": 0.0, "rejected": True}


def test_decisions_equal_plain_compression(spark):
    """The totals of whole texts, cut into blocks, compressed with dictionaries that are made anew from the same words."""
    import zstandard
    df = labelled(spark, 400)
    classifier = language_id.train(df.where("doc_id % 4 <> 2"))
    words = {}
    for r in sorted(language_id.training_words(df.where("doc_id % 4 <> 2"), "text", "lang").collect(), key=lambda r: r.order):
        words.setdefault(r.lang, []).append(r.word)
    assert {lang: " ".join(w).encode()[-language_id.DICTIONARY_BYTES:] for lang, w in words.items()} == classifier.dictionaries
    long = " ".join(r.text for r in df.limit(90).collect())
    given = [r.text for r in df.where("doc_id % 4 = 2").collect()] + [long, "ka", "déjà vu yth"]
    for text in given:
        data = " ".join(re.findall(r"[^\W\d_]+", text.lower())).encode()
        size = {}
        for lang in classifier.languages:
            d = zstandard.ZstdCompressionDict(classifier.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(dict_data=d, level=language_id.LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False)
            size[lang] = sum(len(c.compress(data[i:i + language_id.BLOCK_BYTES])) for i in range(0, len(data), language_id.BLOCK_BYTES))
        best, second = sorted(size.values())[:2]
        got = classifier.classify(text, classifier.open())
        assert size[got["lang_pred"]] == best and got["rejected"] == (second / best - 1 < language_id.MARGIN)


def test_training_sample_is_bounded(spark):
    df = labelled(spark, 900)
    rows = language_id.training_words(df, "text", "lang", rows=20, dictionary_bytes=400).collect()
    assert Counter(r.lang for r in rows) == {lang: 100 for lang in LANGS}
    # copies count once, whatever their number, and no text is cut
    copies = df.union(df.sparkSession.createDataFrame([(5000 + i, "zzz " * 4000 + "end", "aa") for i in range(50)], df.schema))
    some = language_id.training_words(copies, "text", "lang", dictionary_bytes=1 << 20).where("lang = 'aa'").collect()
    assert Counter(r.word for r in some)["zzz"] == 4000 and Counter(r.word for r in some)["end"] == 1
    many = df.select("doc_id", "text", df.doc_id.cast("string").alias("lang"))
    assert len(language_id.train(many).languages) == 900      # no language is left out


def tokens(text):
    return (text or "").encode().lower().split() + [b""]


@pytest.mark.parametrize("head", [0, 3, 1 << 17])
def test_base_scores_are_exact(spark, docs, head, monkeypatch):
    monkeypatch.setattr(bloom_lm, "HEAD", head)
    monkeypatch.setattr(bloom_lm, "CHUNK_TOKENS", 500)
    monkeypatch.setattr(bloom_lm, "SCORE_TOKENS", 300)
    train = docs.where("doc_id % 2 = 0 OR doc_id IS NULL")
    model, singles = bloom_lm.train(train.select(train.text.cast("binary")))
    counts = Counter(t for r in train.collect() for t in tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    got = bloom_lm.score_texts(docs.select("doc_id", "text"), model, singles).collect()
    want = Counter()
    for r in docs.collect():
        t = tokens(r.text)
        want[(r.doc_id, len(t), sum(counts[x] > 0 for x in t), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t), 4))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score <= 0 for r in got)


def test_filter_reads_levels_back():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    counts = rng.geometric(0.3, len(keys)) ** 2
    bits = 1 << 8
    data = np.zeros(bloom_lm.BLOCKS * bits // 8, np.uint8)
    for b, made in bloom_lm.build_blocks(keys, counts, bits).items():
        data[b * bits // 8:(b + 1) * bits // 8] = np.frombuffer(made, np.uint8)
    f = bloom_lm.LogFrequencyFilter(data, bits)
    read = f.read_levels(keys)
    assert (read >= bloom_lm.levels_of(counts)).all() and (read == bloom_lm.levels_of(counts)).mean() > 0.9    # one-sided error
    assert (f.read_levels(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)) > 0).mean() < 0.1


def test_model_prefers_what_it_has_seen(spark, empty, monkeypatch):
    rows = [(i, "the cat sat on the mat and the dog ran off") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    model, singles = bloom_lm.train(df.select(df.text.cast("binary")))
    probe = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "mat the on sat cat the"), (3, "unseen words only")], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in bloom_lm.score_texts(probe, model, singles).collect()}
    assert got[1] > got[2] > got[3]
    assert bloom_lm.score_texts(empty.select("doc_id", "text"), model, singles).count() == 0
    monkeypatch.setattr(bloom_lm, "MAX_BITS", 60)          # room for the frequent levels only: still a model, base scores stay exact
    small, singles = bloom_lm.train(df.select(df.text.cast("binary")))
    assert small.n == model.n and small.v == model.v
    model, singles = bloom_lm.train(empty.select(empty.text.cast("binary")))
    assert {(r.base_score, r.score) for r in bloom_lm.score_texts(probe, model, singles).collect()} == {(0.0, 0.0)}


def render(df, part_chars):
    out = Counter()
    for conv in {r.conv_id for r in df}:
        turns = sorted([r for r in df if r.conv_id == conv], key=lambda r: (r.turn is not None, r.turn, (r.role or "unknown").encode()))
        for speaker in {r.role or "unknown" for r in turns} - {"system"}:
            text, masks = "", []
            for r in turns:
                name = r.role or "unknown"
                head = "<|assistant|>\n" if name == speaker else "<|system|>\n" if name == "system" else f"<|user|>{name}\n"
                if name == speaker:
                    masks.append((len(text) + len(head), len(text) + len(head) + len(r.text or "") + 8))
                text += head + (r.text or "") + "<|end|>\n"
            out[(conv, speaker, text, tuple(masks))] += 1
    return out


def test_chat_rotations(spark):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["ann", "bob", "cy", "system", None]), rng.choice([None, "", "hi", "é" * 50])) for c in [1, 2, 3, None] for t in range(12)]
    rows += [(4, 0, "system", "alone"), (5, None, "ann", "a"), (5, 1, "bob", "b"), (5, 1, "bob", "b")]
    rows += [(6, t, "ann" if t % 2 else "bob", "long " * 3) for t in range(400)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, speaker string, part int").repartition(4)
    want = render(df.collect(), 0)
    whole = chat.chat_rotations(df, part_chars=1 << 40).collect()
    assert Counter((r.conv_id, r.speaker, r.rendered, tuple(map(tuple, r.masks))) for r in whole) == want
    pieces = defaultdict(list)
    for r in chat.chat_rotations(df, part_chars=100).collect():
        pieces[(r.conv_id, r.speaker)].append(r)
    assert len(pieces) == len(want)
    for (conv, speaker), parts in pieces.items():
        text, masks = "", []
        for r in sorted(parts, key=lambda r: r.part):
            assert r.start == len(text)
            masks += [(r.start + a, r.start + b) for a, b in r.masks]
            text += r.rendered
        assert want[(conv, speaker, text, tuple(masks))] == 1
    assert chat.chat_rotations(df.where("false")).count() == 0


def brute_top(rows, queries, k):
    vectors = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for q, qv in [x for x in vectors if x[0] in queries]:
        scores = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in vectors if i != q)[:k]
        for rank, (s, i) in enumerate(scores, 1):
            out[(q, rank, i, -s)] += 1
    return out


def test_top_k(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, rng.uniform(-1, 1)]) for _ in range(8)]) for i in range(250)]
    rows += [(i, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(300, 330)]          # ties
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [1.0] * 8), (404, []), (405, [1.0, 2.0]), (406, [0.0] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, rank int").repartition(5)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = topk.exact_top_k(df.where("vec_id % 100 = 0"), df, 10, query_rows=2, candidate_rows=37).collect()
    assert Counter(map(tuple, got)) == brute_top(rows, {0, 100, 200, 300, 400}, 10)
    few = df.where("vec_id < 4")
    assert Counter(map(tuple, topk.exact_top_k(few, few, 10).collect())) == brute_top([r for r in rows if r[0] in (0, 1, 2, 3)], {0, 1, 2, 3}, 10)
    assert topk.exact_top_k(df.where("false"), df).count() == 0 and topk.exact_top_k(df, df.where("false")).count() == 0


def test_top_k_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.exact_top_k(df, df, 3).collect()}
    assert got[(0, 1)] == (1, 2 ** 63 - 1) and got[(0, 2)] == (3, 1024 ** 2) and got[(0, 3)] == (2, -2 ** 63)
