"""Prefix encoding, fill-in-middle and tokenizer alignment against the libraries and brute-force versions."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import alignment, fill_in_middle, prefix_bpe
from keelson.llm.common import stored
from keelson.llm.tokens import byte_alphabet, packed, vocabulary_path

PIECES = ["a", "B", " ", "  ", "\n", "\t", " \n", "'s", "'T", "1", "²", "é", "É", "\xa0", " ", "\x1c", "\x85", "<|endoftext|>", "</s>", "!", "--",
          "中", "🙂", "İ", "ﬁ", "\r\n", "٣", "the", " and", "don't,", "\x00", ".", "abab", "ing", "<P>", "<P", ">", "S>", "<"]


def texts(n, longest=50, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(longest))) for _ in range(n)]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def library():
    import tiktoken
    import public_tokenizers
    with open(vocabulary_path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return prefix_bpe.coder("byte_bpe_50k.tiktoken")


def test_prefix_encoder_equals_the_library(coder, library):
    for t in texts(2000) + ["a" * 3000, "ab" * 2000, "", " ", "x" * 1000 + " " * 700]:
        ids = packed(library.encode_ordinary(t))
        assert coder.encode(t) == ids, t
        assert coder.decode(ids) == t.encode()


def test_every_prefix_has_its_own_encoding(coder, library):
    data = ("straightforwardness" * 3).encode()
    table = coder.extend([], data)
    for n in range(1, len(data) + 1):
        assert coder.tokens(table[:n]) == library._encode_single_piece(data[:n])
    assert coder.extend(table[:20], data) == table


def test_edits_equal_encoding_anew(coder, library):
    rng = random.Random(9)
    for n in range(600):
        held = prefix_bpe.PrefixText(coder, texts(1, 30, n)[0] if n % 3 else rng.choice("ab") * rng.randrange(900) + "the" * 200)
        for _ in range(4):
            at, removed, added = rng.randrange(len(held.text) + 3), rng.randrange(4 if n % 5 else 300), texts(1, 4, rng.random())[0]
            want = held.text[:at] + added + held.text[min(at, len(held.text)) + removed:]
            held.edit(at, removed, added)
            assert held.text == want and held.ids() == packed(library.encode_ordinary(want))
    held = prefix_bpe.PrefixText(coder, "the" * 20_000)
    first = held.computed
    held.edit(30_000, 1, "zz")
    held.append("ing")
    assert first == 60_000 and held.computed - first < 600


def test_prefix_operators(spark, docs, empty, library):
    rows = docs.collect()
    want = Counter()
    for r in rows:
        ids = packed(library.encode_ordinary(r.text or ""))
        want[(r.doc_id, len(ids) // 4, sha(ids), sha((r.text or "").encode()))] += 1
    assert Counter(map(tuple, prefix_bpe.prefix_round_trip(docs).collect())) == want
    back = prefix_bpe.prefix_decode(prefix_bpe.prefix_encode(docs)).collect()
    assert Counter((r.doc_id, bytes(r.content)) for r in back) == Counter((r.doc_id, (r.text or "").encode()) for r in rows)
    for f in (prefix_bpe.prefix_round_trip, prefix_bpe.prefix_encode):
        assert f(empty).count() == 0
    assert prefix_bpe.prefix_decode(spark.createDataFrame([(1, None)], "doc_id int, ids binary")).collect() == [(1, None)]


def test_reencode_operator(spark, library):
    edits = [(1, "the cat sat", [(4, 3, "dog"), (11, 0, " down")]), (2, None, None), (None, "a  b", [(1, 1, None), None, (99, 5, "é")]), (3, "", [(0, 0, "x")])]
    df = spark.createDataFrame(edits, "doc_id int, text string, e array<struct<at: bigint, removed: bigint, added: string>>")
    got = {r.doc_id: (r.text, bytes(r.ids)) for r in prefix_bpe.prefix_reencode(df, "e").collect()}
    want = {1: "the dog sat down", 2: "", None: "a bé", 3: "x"}
    assert got == {k: (t, packed(library.encode_ordinary(t))) for k, t in want.items()}


def test_files_out_of_order_are_refused(tmp_path):
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab"]
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    with pytest.raises(ValueError, match="before its parts"):
        prefix_bpe.PrefixBpe(str(path))
    path.write_bytes(base64.b64encode(b"a") + b" 0")
    with pytest.raises(ValueError, match="first 256"):
        prefix_bpe.PrefixBpe(str(path))


def middle(doc_id, text):
    h = [int(sha(f"1:{'' if doc_id is None else doc_id}".encode())[k:k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.fixture(params=[7, 1 << 20])
def window(request, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "WINDOW", request.param)
    monkeypatch.setattr(fill_in_middle, "BLOCK_BYTES", request.param * 5)


def test_displacement_blocks(window):
    rng = random.Random(11)
    import pyarrow as pa
    for _ in range(150):
        some = texts(rng.randrange(1, 12), 30, rng.random())
        made = [middle(rng.randrange(10 ** 6), t) for t in some]
        form = np.array([("plain", "psm", "spm").index(m[1]) for m in made])
        cuts = np.array([(m[2] or 0, m[3] or 0, m[0]) for m in made]).T
        out = fill_in_middle.scatter(*fill_in_middle.text_bytes(pa.array(["zz", *some]).slice(1)), form, *cuts)
        assert fill_in_middle.strings(*out).to_pylist() == [m[4] for m in made]
        assert fill_in_middle.strings(*fill_in_middle.gather(*out, form)).to_pylist() == some
    for bad in ("<P>a<S>b<M>c<M>", "<P>a<M>c", "<S>a<P>b<M>c", "x<P>a<S>b<M>c"):
        with pytest.raises(ValueError, match="exactly one of each"):
            fill_in_middle.gather(*fill_in_middle.text_bytes(pa.array([bad])), np.array([1]))


def test_fim_operators(spark, docs, empty):
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts(300))], "doc_id bigint, text string")
    rows = docs.select("*", F.lit("x").alias("n"), F.lit("y").alias("form")).unionByName(extra, allowMissingColumns=True)
    given = [(r.doc_id, r.text) for r in rows.select("doc_id", "text").collect()]
    want = [(i, *middle(i, t or "")) for i, t in given]
    made = fill_in_middle.fim_transform(rows)
    assert Counter(map(tuple, made.collect())) == Counter(want) and {w[2] for w in want} == {"plain", "psm", "spm"}
    assert Counter(map(tuple, fill_in_middle.fim_restore(made).collect())) == Counter((i, t or "") for i, t in given)
    digests = Counter((*w[:5], sha(w[5].encode()), sha((t or "").encode())) for w, (_, t) in zip(want, given))
    assert Counter(map(tuple, fill_in_middle.fim_digests(rows).collect())) == digests
    assert fill_in_middle.fim_transform(empty).count() == fill_in_middle.fim_digests(empty).count() == 0
    assert fill_in_middle.fim_restore(spark.createDataFrame([(1, None, None)], "doc_id int, output string, form string")).collect() == [(1, None)]


def brute_alignment(given):
    """doc -> (n_a, n_b, groups, links), whole texts at once."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    a, b = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    byte = {c: bytes([n]) for n, c in byte_alphabet().items()}
    found = []
    for text in given:
        a_ids, b_ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        a_bytes = [b"".join(byte[c] for c in a.id_to_token(i)) for i in a_ids]
        b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in b_ids for p in [b.id_to_piece(i)]]
        if not text or {b"".join(a_bytes), b"".join(b_bytes)} != {(" " + text).encode()}:
            found.append((0, 0, "", []))
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
        groups, links, low = [], [], (0, 0)
        for end in sorted(set(a_end) & set(b_end)):
            i, j = np.searchsorted(a_end, end) + 1, np.searchsorted(b_end, end) + 1
            groups.append(",".join(map(str, a_ids[low[0]:i])) + "|" + ",".join(map(str, b_ids[low[1]:j])))
            links.append((a_ids[i - 1], b_ids[j - 1]))
            low = i, j
        found.append((len(a_ids), len(b_ids), ";".join(groups), links))
    return found


@pytest.mark.parametrize("heavy", [alignment.HEAVY, 20, 1])
def test_alignment_equals_brute_force(spark, docs, heavy):
    odd = [" a", "  a b", "▁x", "a ▁", "a\n b", " ", "\x1c b", "a \x1c b", "a  \n  b", "</s> <s>", "<|endoftext|> x", "ﬁ ½ é"]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts(400) + odd)], "doc_id bigint, text string")
    df = docs.select("*", F.lit(1).alias("row"), F.lit("g").alias("groups")).unionByName(extra, allowMissingColumns=True)
    given = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    brute = brute_alignment([t for _, t in given])
    counts = Counter(link for *_, links in brute for link in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = Counter((i, n_a, n_b, g.count(";") + bool(g), g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links))
                   for (i, _), (n_a, n_b, g, links) in zip(given, brute))
    aligned = stored(alignment.align_texts(df), "test-aligned")
    pairs = stored(alignment.pair_counts(aligned), "test-pairs")
    assert {(r.a_id, r.b_id): (r.n, r.best) for r in pairs.collect()} == {(a, b): (n, n == most[b]) for (a, b), n in counts.items()}
    got = alignment.linked_counts(aligned, pairs, heavy=heavy).drop("row").select("doc_id", "n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum")
    assert Counter(map(tuple, got.collect())) == want
    if heavy == alignment.HEAVY:
        digests = Counter((*w[:4], *w[5:], sha(w[4].encode()) if w[4] else "") for w in want.elements())
        assert Counter(map(tuple, alignment.alignment_digests(df).collect())) == digests


def test_alignment_of_odd_tables(spark, empty):
    assert alignment.alignment_digests(empty).count() == 0
    blank = spark.createDataFrame([(None, None), (1, ""), (1, "")], "doc_id bigint, text string")
    assert Counter(map(tuple, alignment.alignment_digests(blank).collect())) == {(None, 0, 0, 0, 0, 0, 0, ""): 1, (1, 0, 0, 0, 0, 0, 0, ""): 2}


def test_forgetting_words_changes_nothing(monkeypatch):
    small = alignment.PairAligner("byte_bpe_50k.json", "piece_bpe_32k.model", most=5)
    large = alignment.aligner("byte_bpe_50k.json", "piece_bpe_32k.model")
    monkeypatch.setattr(alignment, "KEPT_CHARS", 4)
    for t in texts(200):
        assert not t or "▁" in t or small.align(t) == large.align(t)
