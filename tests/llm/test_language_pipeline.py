"""Language-model scores against direct sums, and the pipeline against brute-force stages."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_packing_tokens import ODD
from test_repeats import brute_words

import corpus_pipeline
from photospark.llm import automaton, language, pii
from photospark.llm.quality import quality

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def direct(texts, share):
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD)), None] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    count = Counter(tuple(w[i : i + n]) for d, w in tokens.items() if not held[d] for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum(n for g, n in count.items() if len(g) == 1)
    types = sum(1 for g in count if len(g) == 1)
    below = total + 0.1 * (types + 1)
    kept = {g: n for g, n in count.items() if len(g) > 1 and n >= share * total}
    left = {}
    for g, n in kept.items():
        left[g[:-1]] = left.get(g[:-1], 1.0) - (n - 0.5) / count[g[:-1]]

    def chance(context, word):
        while context and context not in left:
            context = context[1:]
        if not context:
            return (count[(word,)] + 0.1) / below
        own = (kept[*context, word] - 0.5) / count[context] if (*context, word) in kept else 0
        return own + left[context] * chance(context[1:], word)

    out = {}
    for d, w in tokens.items():
        base = sum(math.log10((count[(x,)] + 0.1) / below) for x in w)
        score = sum(math.log10(chance(tuple(w[max(0, i - 2) : i]), x)) for i, x in enumerate(w))
        out[d] = (held[d], len(w), sum(count[(x,)] > 0 for x in w), total, base, score)
    return out


def check(got, want):
    assert set(got) == set(want)
    for d, row in want.items():
        assert tuple(got[d][:4]) == row[:4]
        assert got[d][4:] == pytest.approx(row[4:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("share", [0.002, 0.05, 1e-9])
def test_scores(spark, share):
    rng = random.Random(11)
    words = [f"v{int(rng.paretovariate(0.8))}" for _ in range(400)]
    texts = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(60))) for i in range(150)}
    texts |= {200 + i: t for i, t in enumerate(ODD)} | {300 + i: "the The THE cat É é sat on " * 30 for i in range(5)}
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in texts.items()], "doc_id bigint, text string, block string, code int").repartition(3)
    rows = language.score(df, share, block_bytes=2000).collect()
    check({r["doc_id"]: tuple(r)[1:] for r in rows}, direct(texts, share))


def model_of(tokens, least):
    """Automaton of the words 0, 1, ... of one text, all of them in the training part; its last word never occurs."""
    n = max(tokens) + 2
    count = Counter(tuple(tokens[i : i + k]) for k in (1, 2, 3) for i in range(len(tokens) - k + 1))
    pairs = sorted(g for g in count if len(g) == 2)
    triples = sorted(g for g in count if len(g) == 3)
    kept = {g: c for g, c in count.items() if len(g) > 1 and c >= least}
    place = {g: i for i, g in enumerate(pairs)}

    def arcs(contexts):
        after = [[c for g, c in kept.items() if g[:-1] == x] for x in contexts]
        return np.array([sum(x) for x in after]), np.array([len(x) for x in after])

    return automaton.Automaton(
        np.array([count[w,] for w in range(n)]), len(tokens) + 0.1 * n,
        tuple(np.array(x) for x in zip(*pairs)), np.array([kept.get(g, 0) for g in pairs]),
        tuple(np.array(x) for x in zip(*[(place[g[:2]], g[2], place[g[1:]]) for g in triples])), np.array([kept.get(g, 0) for g in triples]),
        *arcs([(w,) for w in range(n)]), *arcs(pairs))


def test_probabilities_add_up_to_one():
    rng = random.Random(12)
    model = model_of([rng.randrange(8) for _ in range(3000)], 5)
    for context in ([], [0], [3], [1, 2], [5, 5], [8, 2]):
        texts = [[*context, w] for w in range(9)]
        walked = model.walk(np.concatenate(texts), np.arange(10) * len(texts[0]))
        assert sum(10 ** walked[len(context) :: len(context) + 1]) == pytest.approx(1, abs=1e-9)


def test_lanes_of_a_long_text_carry_its_state():
    """A text cut into lanes costs what one lane that walks it from the start does."""
    rng = random.Random(16)
    tokens = [int(rng.paretovariate(0.6)) % 40 for _ in range(5000)]
    model = model_of(tokens, 2)
    lanes = model.walk(np.array(tokens), np.array([0, 1, 3, 700, 5000]))
    for a, b in ((0, 1), (1, 3), (3, 700), (700, 5000)):
        state, alone = np.zeros(1, np.int64), []
        for w in tokens[a:b]:
            cost, state = model.step(state, np.array([w]))
            alone.append(cost[0])
        assert np.array_equal(lanes[a:b], np.array(alone))


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (1, "a")], "doc_id bigint, text string")
    assert language.score(df).count() == 3
    assert language.score(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    """Each stage takes all that its predecessor kept; its rows equal those of a brute-force version."""
    rng = random.Random(13)
    words = ["".join(rng.choice("aeinorstlmd") for _ in range(rng.randrange(3, 8))) for _ in range(900)]

    def text(n=120):
        return ". ".join(" ".join(rng.choice(words) for _ in range(10)).capitalize() for _ in range(n // 10)) + "."

    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = [text() for _ in range(160)]
    rows += [rows[0], rows[1] + " tail", "short", None, "", "#$ " * 50, "## $$ " + text().upper().replace(" ", "!! #| ")]
    rows += [text(60) + " " + passage + " " + text(60) for _ in range(3)]
    rows += ["call +49 30 1234567 or mail some.one@example.org " + text(), "visa 4111 1111 1111 1111 " + text()]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    from test_neighbours_jaccard import similar

    state = {r["doc_id"]: r["text"] for r in frame.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        path = str(tmp_path / f"stage{k}")
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if k == 0:
            kept = {r["doc_id"] for r in quality(frame).filter("kept").collect()}
            state = {d: t for d, t in state.items() if d in kept}
            assert set(range(160)) <= kept and not kept & {162, 163, 164, 165, 166}
        elif k == 1:
            state = {d: t for d, t in state.items() if similar(state)[d][0] == d}
            assert 160 not in state and 161 not in state
        elif k == 2:
            words_left = brute_words(state)
            state = {d: (words_left[d][2] if words_left[d][1] else t) for d, t in state.items()}
            assert sum(1 for w in words_left.values() if w[1]) == 3
        elif k == 3:
            state = {r["doc_id"]: r["text"] for r in pii.mask(frame).collect()}
            assert "[EMAIL]" in state[170] and "[PHONE]" in state[170] and "[CARD]" in state[171]
        if k < 4:
            assert {r["doc_id"]: r["text"] for r in out.collect()} == state
            assert all(r["n_chars"] == len(r["text"] or "") for r in out.collect())
        else:
            assert {r["doc_id"] for r in out.collect()} == set(state)
        frame = out
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == frame.count()


def test_rare_ngrams_stay_in_large_corpora(spark):
    """The registered model has every pair and triple seen twice, however many tokens there are."""
    rng = random.Random(14)
    texts = {i: " ".join(f"w{rng.randrange(40)}" for _ in range(1000)) for i in range(130)}
    pairs = [i for i in range(200, 300) if zlib.crc32(str(i).encode()) % 10][:2]
    texts |= {i: "rare pair here" for i in pairs}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    rows = {r["doc_id"]: tuple(r)[1:] for r in language.score(df, block_bytes=100_000).collect()}
    total = next(iter(rows.values()))[3]
    assert 2 < 4e-5 * total
    check(rows, direct(texts, 2 / total))


def test_stages_keep_rows_with_null_and_repeated_ids(spark):
    """Every row gets its own verdict and loses its own words, whatever its id."""
    from photospark.llm.quality import keep_good
    from photospark.llm.substrings import remove_repeats

    rng = random.Random(15)

    def text(n):
        return " ".join("".join(rng.choice("aeinorst") for _ in range(5)) for _ in range(n))

    passage, alone = text(60), [text(30) for _ in range(6)]
    rows = [(i, f"{a} {passage}") for i, a in zip([7, 7, 7, None, 8, None], alone, strict=True)] + [(8, "short"), (None, "short")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'en' lang", "'s' source")
    want = sorted((str(i), a) for (i, _), a in zip(rows, [*alone, "short", "short"], strict=True))
    assert sorted((str(r["doc_id"]), r["text"]) for r in remove_repeats(df).collect()) == want
    kept = sorted((str(r["doc_id"]), r["text"]) for r in keep_good(df).collect())
    assert kept == sorted((str(i), t) for i, t in rows if t != "short")
