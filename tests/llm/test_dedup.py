"""Exact and near deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from keelson.llm import exact_dedup, golay, simhash
from keelson.llm.components import connected_components


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def check_exact(df, got):
    groups = defaultdict(list)
    for r in df.collect():
        groups[norm(r.text)].append(r.doc_id)
    assert len(got) == sum(map(len, groups.values()))
    by_sha = defaultdict(list)
    for r in got:
        by_sha[r.text_sha256].append(r)
    assert len(by_sha) == len(groups)
    for text, ids in groups.items():
        rows = by_sha[hashlib.sha256(text.encode()).hexdigest()]
        least = min((i for i in ids if i is not None), default=None)
        assert Counter(r.doc_id for r in rows) == Counter(ids)
        assert {(r.keep_id, r.group_size) for r in rows} == {(least, len(ids))}
        kept = [r for r in rows if r.kept]
        assert len(kept) == 1 and kept[0].doc_id == least


def test_exact_dedup(docs):
    check_exact(docs, exact_dedup.exact_dedup(docs, payload=["doc_id"]).collect())
    whole = exact_dedup.exact_dedup(docs)
    assert set(docs.columns) <= set(whole.columns)
    check_exact(docs, whole.collect())


def test_exact_dedup_of_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_LEAST", 20)
    rows = [(i, "same  text" if i % 2 else f"text {i % 50}") for i in range(1000, 0, -1)] + [(None, "same text"), (7, "same text")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    check_exact(df, exact_dedup.exact_dedup(df).collect())


def test_exact_dedup_of_nothing(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_golay_code():
    words = np.arange(1 << 23)[::97]
    near, more = golay.codewords(words)
    assert len(np.unique(golay.codewords(np.arange(1 << 12) << 11)[0])) > 1 and near.min() >= 0 and near.max() < 4096
    flipped = words[:, None] ^ (1 << np.arange(23))
    for bit in range(23):                                   # words that differ in one bit share a key
        n2, m2 = golay.codewords(flipped[:, bit])
        assert ((n2 == near) | (m2 == near[:, None]).any(axis=1)).all()
        assert ((n2 == near) | (more == n2[:, None]).any(axis=1)).all()


def test_keys_meet_for_all_patterns_of_three_bits():
    rng = random.Random(5)
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        k1 = set(simhash.fuzzy_keys(np.array([a], np.uint64), True)[0].tolist())
        k2 = set(simhash.fuzzy_keys(np.array([b], np.uint64), False)[0].tolist())
        assert k1 & k2


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(docs):
    rows = docs.collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    part = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= 3:
                    part[i] = part[j] = min(part[i], part[j])
    least = {p: min((r.doc_id for r, q in zip(rows, part) if q == p and r.doc_id is not None), default=None) for p in part}
    want = Counter((r.doc_id, f"{f:016x}", least[p]) for r, f, p in zip(rows, fps, part))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want


def test_simhash_of_nothing(empty):
    assert simhash.near_duplicates(empty).count() == 0


def test_fingerprint_votes_in_chunks(monkeypatch):
    text = " ".join(f"a{i % 37}" for i in range(500))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "VOTE_CHUNK", 7)
    assert simhash.fingerprint(text.encode()) == whole and whole & (1 << 64) - 1 == plain_fingerprint(text)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


def test_near_copies_are_dropped(spark, docs, empty):
    """Every component keeps its smallest identifier; equal identifiers and null ones are told apart by their texts."""
    rng = random.Random(3)
    rows = []
    for i in range(80):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(80, 400))]
        rows.append((i, " ".join(w)))
        for k in range(3):
            edited = list(w)
            edited[rng.randrange(len(w))] = f"new{k}"
            rows.append((rng.choice([1000 + 3 * i + k, None, 5000]), " ".join(edited)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    fps = [plain_fingerprint(t) for _, t in rows]
    part = list(range(len(rows)))
    for _ in range(6):
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(fps[i] ^ fps[j]).count("1") <= 3:
                    part[i] = part[j] = min(part[i], part[j])
    got = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(df).collect()]
    assert len(got) == len(set(part)) < len(rows) and set(got) <= set(rows)
    place = {row: p for row, p in zip(rows, part)}
    assert len({place[g] for g in got}) == len(got)
    for row in got:
        own = [i for (i, _), p in zip(rows, part) if p == place[row] and i is not None]
        assert row[0] == min(own, default=None)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and simhash.drop_near_duplicates(empty).count() == 0
    assert Counter(r.doc_id for r in kept.collect())[2] == 2               # a repeated row stays as often as it is there
