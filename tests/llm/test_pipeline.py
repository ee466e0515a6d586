"""The corpus pipeline's stages take effect, on the columns of documents."""

import random
from collections import Counter

import corpus_pipeline
from keelson.llm.registry import QUERIES
from keelson.llm.tokens import TextEncoder, vocabulary_path
from test_dedup import plain_fingerprint


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    words = {"en": ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)], "fr": ["é" + "".join(rng.choice("klmnopqr") for _ in range(5)) for _ in range(300)]}
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "fr"
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(200)), lang, "s", 1))
    rows += [(100 + i, rows[i][1].replace(" ", "  "), rows[i][2], "s", 1) for i in range(10)]              # equal but for white space
    rows += [(200 + i, rows[i][1] + " tail", rows[i][2], "s", 1) for i in range(10)]                       # near copies
    rows += [(300, None, "en", "s", 1), (301, "12 34 !!", "en", "s", 1), (302, "", None, "s", 1)]             # no language
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    # brute force: equal texts first, then components of fingerprints that differ in at most three bits
    seen, kept = set(), []
    for i, t, *_ in sorted(rows[:-3], key=lambda r: r[0]):
        plain = " ".join(t.split(" ")).replace("  ", " ")
        if plain not in seen:
            seen.add(plain)
            kept.append((i, t, plain_fingerprint(t)))
    root = {i: i for i, *_ in kept}
    for _ in kept:
        for i, _, f in kept:
            for j, _, g in kept:
                if bin(f ^ g).count("1") <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    stay = [(i, t) for i, t, _ in kept if root[i] == i]
    assert 60 <= len(stay) < len(kept) == 70
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    encoder = TextEncoder(vocabulary_path("byte_bpe_50k.json"), False)
    length = Counter()
    for r in got:
        length[r.doc_id] += r.length
    assert dict(length) == {i: len(encoder.encode(t)) // 4 + 1 for i, t in stay}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "packing"]


def test_stages_on_an_empty_table(spark, docs, tmp_path):
    frame = docs.where("false").select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        assert out.count() == 0 and (name == "packing" or out.columns == frame.columns)


def test_stages_on_odd_rows(spark, docs):
    """Nulls, empty and long texts, repeated rows and extra columns: what each stage keeps of them."""
    stages, rows = dict(corpus_pipeline.STAGES), docs.collect()
    letters = Counter(r.doc_id for r in rows if any(c.isalpha() for c in r.text or ""))
    known = Counter(r.doc_id for r in stages["language_id"](spark, docs, "").collect())
    assert known <= letters and not {3, 4, 5} & set(known)
    unique = stages["exact_dedup"](spark, docs, "")
    assert unique.columns == docs.columns and Counter(r.doc_id for r in unique.collect())[6] == 0
    near = stages["near_dedup"](spark, docs, "")
    ids = Counter(r.doc_id for r in near.collect())
    # the null and the empty texts are one group, of which 3 is the smallest; repeated rows stay together
    assert near.columns == docs.columns and ids[3] == 1 and ids[4] == 0 and ids[1] == 1 and ids[6] == 0 and ids[200] == 1
    packed = stages["packing"](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
