"""Substring and suffix deduplication against sets of all windows."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from photospark.llm import repeats, substrings, suffixes


def brute_words(texts, width=35):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in texts.items()}
    count = Counter(tuple(w[i : i + width]) for w in words.values() for i in range(len(w) - width + 1))
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def brute_bytes(texts, width=100):
    seen, out = set(), {}
    for d in sorted(texts):
        b = (texts[d] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            s = b[i : i + width]
            if s in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(s)
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


def word_texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rng.choice([2, 3, 5, 50]))]
    base = [rng.choice(vocabulary) for _ in range(600)]
    out = []
    for i in range(60):
        kind = rng.random()
        if kind < 0.3:
            a = rng.randrange(500)
            x = base[a : a + rng.randrange(100)]
        elif kind < 0.5:
            x = [rng.choice(vocabulary) for _ in range(rng.randrange(150))] + base[100 : 100 + rng.randrange(80)] + [rng.choice(vocabulary) for _ in range(50)]
        elif kind < 0.6:
            x = ["a", "b", "c"][: rng.randrange(1, 4)] * rng.randrange(60)
        elif kind < 0.7:
            x = ["z"] * rng.randrange(90)
        else:
            x = [f"{i}-{j}" for j in range(rng.randrange(90))]
        out.append(rng.choice([" ", "\n", " \t"]).join(x) if rng.random() < 0.95 else None)
    return dict(enumerate(out))


def byte_texts(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefé "
    base = "".join(rng.choice(letters) for _ in range(2000))
    out = {}
    for i in range(50):
        kind = rng.random()
        if kind < 0.5:
            a = rng.randrange(1500)
            x = base[a : a + rng.randrange(400)]
        elif kind < 0.7:
            x = "".join(rng.choice(letters) for _ in range(rng.randrange(300))) + base[100 : 100 + rng.randrange(300)]
        elif kind < 0.8:
            x = "abc"[: rng.randrange(1, 4)] * rng.randrange(200)
        else:
            x = "".join(chr(rng.randrange(32, 1000)) for _ in range(rng.randrange(200)))
        out[i * 7 % 61] = x if rng.random() < 0.95 else None
    return out


def frame(spark, texts):
    return spark.createDataFrame([(d, t, 1, "k", 0) for d, t in texts.items()], "doc_id bigint, text string, place int, key string, doc int").repartition(3)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_words(spark, seed):
    texts = word_texts(seed)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.dedup(frame(spark, texts)).collect()}
    assert got == brute_words(texts)


@pytest.mark.parametrize("seed", [0, 1])
def test_bytes(spark, seed, monkeypatch):
    texts = byte_texts(seed)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.dedup(frame(spark, texts)).collect()}
    assert got == brute_bytes(texts)


def test_long_texts_and_copies(spark):
    rng = random.Random(9)
    long = " ".join(f"q{rng.randrange(10**6)}" for _ in range(150_000))
    texts = {1: long, 2: "x " + long[:5000], 3: None, 4: "", 5: long[-400:]}
    got = {r["doc_id"]: r for r in substrings.dedup(frame(spark, texts)).collect()}
    want = brute_words(texts)
    assert {d: (r["n_words"], r["n_removed"]) for d, r in got.items()} == {d: w[:2] for d, w in want.items()}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.dedup(frame(spark, texts)).collect()}
    assert got == brute_bytes(texts)


def test_blocks_of_suffixes_do_not_matter():
    import numpy as np

    rng = random.Random(3)
    text = "".join(rng.choice("abcd") for _ in range(5000))
    body = np.frombuffer(text.encode(), np.uint8)
    whole = suffixes.claims_of(body, np.array([0, 5000]), np.array([7]), 100, 32)
    starts = sorted(s for part in whole for a, b in [repeats.unpack(part[3])] for x, y in zip(a, b, strict=True) for s in range(x, y + 1))
    assert starts == list(range(4901))


def test_every_window_has_one_claim():
    texts = pa.array([t or "" for t in word_texts(4).values()], pa.large_string())
    codes, offsets = substrings.word_codes(texts)
    import numpy as np

    _, _, ids, place = substrings.claims_of(codes, offsets, np.arange(len(texts)), 35, 6)
    first, last = repeats.unpack(place)
    got = sorted((d, s) for d, a, b in zip(ids, first, last, strict=True) for s in range(a, b + 1))
    assert got == [(d, s) for d in range(len(texts)) for s in range(offsets[d + 1] - offsets[d] - 34)]


def test_empty_tables_and_missing_ids(spark):
    docs = frame(spark, {1: "a"})
    assert substrings.dedup(docs.limit(0)).count() == 0
    assert suffixes.dedup(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "a " * 50), (2, "a " * 50), (2, "a " * 50)], "doc_id bigint, text string")
    assert substrings.dedup(twice).count() == 3
    assert suffixes.dedup(twice).count() == 3


def test_remove_repeats_keeps_columns_and_other_texts(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(1, f"one\n{passage} end", 9, "r", "k"), (2, f"{passage}", 9, "r", "k"), (3, "clean  text\nstays", 17, None, None), (4, None, None, None, None), (None, "x", 1, "", "")],
        "doc_id bigint, text string, n_chars bigint, row string, kept string")
    out = {r["doc_id"]: r for r in substrings.remove_repeats(docs).collect()}
    assert substrings.remove_repeats(docs).schema == docs.schema
    assert out[1]["text"] == "one end" and out[1]["n_chars"] == 7 and out[1]["row"] == "r" and out[1]["kept"] == "k"
    assert out[2]["text"] == "" and out[3]["text"] == "clean  text\nstays" and out[4]["text"] is None and out[None]["text"] == "x"
