"""Alignment against plain loops over whole texts encoded by the libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from photospark.llm import alignment

ODD = [
    None, "", " ", "a", "  two  spaces ", "tab\tnew\n\nline \n x", "don't stop, they'll (go) 'SX'!?", "a b c 　d", "x\x1cy\x1f z", "<|endoftext|> and a<|endoftext|>b <s> </s><unk>",
    "▁already ▁▁ here ▁", "日本語 テキスト🙂 emoji🙂🙂", "é" * 50, "\x00\x01", "mixed123numbers 45,678.90", "….…,,, —dash— «q»", "word " * 3000, "ab" * 4000, "a" * 3001,
    " " * 500 + "x", "\n", "\nx", "<0x41> <0xE3>", "ĠĊ Ġx",
]


def brute(texts):
    """Per text: (n_a, n_b, groups) and the links as pairs of ids with multiplicity."""
    a_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = alignment._byte_values()
    out = []
    for text in texts:
        want = (" " + (text or "")).encode()
        a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_lib.encode(text or "")
        ab = [bytes(shown[c] for c in a_lib.id_to_token(i)) for i in a]
        bb = [bytes([int(b_lib.id_to_piece(i)[1:-1], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
        groups = []
        if text and b"".join(ab) == want == b"".join(bb):
            ends_a, ends_b = (np.cumsum([len(t) for t in side]).tolist() for side in (ab, bb))
            both = sorted(set(ends_a) & set(ends_b))
            i = j = 0
            for end in both:
                x, y = i, j
                while i < len(a) and ends_a[i] <= end:
                    i += 1
                while j < len(b) and ends_b[j] <= end:
                    j += 1
                groups.append((a[x:i], b[y:j]))
        out.append(groups)
    return out


def wanted(texts):
    groups = brute(texts)
    links = [Counter((p, q) for a, b in g for p in a for q in b) for g in groups]
    count = Counter(pair for own in links for pair in own)
    highest = {}
    for (p, _), n in count.items():
        highest[p] = max(highest.get(p, 0), n)
    rows = []
    for g, own in zip(groups, links, strict=True):
        listed = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        rows.append((
            sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), sum(m for k, m in own.items() if count[k] == highest[k[0]]),
            sum(m * count[k] for k, m in own.items()), hashlib.sha256(listed.encode()).hexdigest() if g else ""))
    return rows


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    bits = ["the", " ", "  ", "\n", "é", "'s", ",", ".", "123", "Word", "🙂", "▁", "\t", "-", "(x)", "日本", " of", " inthedst", "\x1c"]
    return ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(120))) for _ in range(250)]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_equals_brute_force(spark, texts):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id bigint, text string, block int, pairs int").repartition(4)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs).collect()}
    want = wanted(texts)
    wrong = [i for i in range(len(texts)) if got[i] != want[i]]
    assert not wrong, (texts[wrong[0]], got[wrong[0]], want[wrong[0]])


def test_small_slices_portions_and_memory(spark, texts, monkeypatch):
    monkeypatch.setattr(alignment, "EXPANDED", 50)
    memory = alignment._Memory.__init__
    monkeypatch.setattr(alignment._Memory, "__init__", lambda self, aligner: memory(self, aligner, 40))
    monkeypatch.setattr(alignment, "slices", lambda batches, limit, cut=alignment.slices: cut(batches, 2000))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(2)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in alignment.align(docs).collect()}
    assert [got[i] for i in range(len(texts))] == wanted(texts)


def test_repeated_null_and_no_rows(spark):
    texts = ["one two", "one two", None, "three"]
    docs = spark.createDataFrame([(5, texts[0]), (5, texts[1]), (None, texts[2]), (None, texts[3])], "doc_id bigint, text string")
    got = [tuple(r) for r in alignment.align(docs).collect()]
    assert sorted(got, key=str) == sorted([(i, *w) for i, w in zip((5, 5, None, None), wanted(texts), strict=True)], key=str)
    assert alignment.align(docs.limit(0)).collect() == []
    assert len(alignment.align(docs.filter("text is null")).collect()) == 1


def test_pointers_reach_the_last_token():
    rng = np.random.default_rng(2)
    for _ in range(200):
        total = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, total + 1, rng.integers(1, 30)), total)) for _ in "ab")
        got_a, got_b = alignment.labels(a, b)
        both = np.intersect1d(a, b)
        assert np.array_equal(got_a, np.searchsorted(both, a)) and np.array_equal(got_b, np.searchsorted(both, b))
    long = np.arange(2, 40_002, 2)
    a, b = alignment.labels(np.append(long, 40_001), np.append(long - 1, 40_001))
    assert a.max() == b.max() == 0
