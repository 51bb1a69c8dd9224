"""Quality rules and personal data against plain Python."""

import collections
import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from photospark.llm import pii, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [None, "", " \n\t ", "one", "a b c d e f g h i j", "x y z u v " * 6, "é è ç #|$ é\n\né è ç #|$ é\n", "a\x1cb c\x85d　e", "l\nl\n l\nm"]


def rules(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        c = int(c)
        total += c if i % 2 == 0 else 2 * c - 9 * (c > 4)
    return total % 10 == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda m=m: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=digits: 16 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 8 <= len(d) <= 15,
            }[kind]()
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_text_rules(spark):
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice(["a", "b", "cc", "#d", "é"]) for _ in range(rng.randrange(80))) for _ in range(60)]
    texts.append(" ".join(str(rng.randrange(2000)) for _ in range(60_000)))
    docs = spark.createDataFrame([(i, t, None if i % 3 else "en", None if i % 5 else "s", None) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.text_rules(docs).collect()}
    assert got == {i: rules(t) for i, t in enumerate(texts)}


def test_outliers_go_and_plain_texts_stay(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 9))) for _ in range(500)]

    def plain():
        return " ".join(" ".join(rng.choice(vocabulary) for _ in range(8)).capitalize() + "." for _ in range(8))

    rows = [(i, plain(), "en", f"s{i % 2}", 1) for i in range(400)]
    junk = [(1000 + i, " ".join("#$" + w.upper() + "!!" for w in plain().split()), "en", "s0", 1) for i in range(40)]
    few = [(2000 + i, plain(), "xx", "tiny", 1) for i in range(5)]
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows + junk + few, DOCS)).collect()}
    assert len(verdict) == 445
    assert all(verdict[i] for i, *_ in rows + few)
    assert not any(verdict[i] for i, *_ in junk)


def test_small_groups_are_judged_by_their_language(spark):
    """Clean texts of a small language that looks unlike the others stay, junk in it goes, and nothing happens at 50 documents."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 9))) for _ in range(500)]

    def plain():
        return " ".join(" ".join(rng.choice(vocabulary) for _ in range(8)).capitalize() + "." for _ in range(8))

    def joined():
        return " ".join("".join(rng.choice(vocabulary) for _ in range(5)) for _ in range(30))

    rows = [(i, plain(), "en", "s", 1) for i in range(300)]
    rows += [(1000 + i, joined(), "zz", f"s{i % 4}", 1) for i in range(45)]
    rows += [(2000 + i, joined(), "yy", "s", 1) for i in range(5)]
    junk = [(3000, " ".join("#$" + w.upper() + "!!" for w in joined().split()), "zz", "s0", 1)]

    def verdict(more):
        return {r["doc_id"]: (r["kept"], r["distance2"]) for r in quality.quality(spark.createDataFrame(rows + junk + more, DOCS)).collect()}

    got = verdict([])
    assert all(got[i][0] for i, *_ in rows)
    assert not got[3000][0]
    assert all(got[2000 + i][1] is None for i in range(5))
    later = verdict([(4000 + i, joined(), "zz", "s0", 1) for i in range(10)])
    assert all(later[i][0] for i, *_ in rows) and not later[3000][0]


def test_quality_of_odd_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert quality.quality(empty).count() == 0
    docs = spark.createDataFrame([(i % 4, t, None, None, None, 1, 2) for i, t in enumerate(ODD)] * 2, DOCS + ", words int, grp int")
    assert quality.quality(docs).count() == 2 * len(ODD)
    assert quality.keep_good(docs).columns == docs.columns


def test_quality_runs_no_python(spark, capsys):
    quality.text_rules(spark.createDataFrame([], DOCS)).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


TEXTS = [
    None, "", "write to a.b+c@ex-ample.co.uk, or x@y or @z", "10.0.0.1 256.1.1.1 1.2.3.4.5 00000255.1.1.1 99999999999.1.1.1",
    "card 4111 1111 1111 1111 and 4111111111111112, 5500-0000-0000-0004", "+44 (0)20 7946 0958, +1-2, +123456789012345678",
    "é日本 mail é@x.de a@b.c_x@d.e", "account GB82 WEST 1234 5698 7654 32 or GB00 WEST 1234 5698 7654 32", "ssn 078-05-1120 but 078-05-1120 far away " + "x" * 60 + " 123-45-6789",
]


def test_base_spans(spark):
    rng = random.Random(3)
    bits = ["a@b.c", "_", "@b.", "c", "4111111111111111", "1.2.3.4", "+49 30 1234567", "x", "é", " ", "-", ".", "7", "@", "\n"]
    texts = TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(200)] + ["7 " * 50_000 + "a@b.cd", "x" * 20_000 + "@", "1" * 20_000 + ".1.1", "a@b" + ".c" * 20_000, "+1" + " 2" * 20_000]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    base = F.filter("pii", lambda s: s["kind"].isin([k.name for k in pii.BASE]))
    got = {r["doc_id"]: r["spans"] for r in found.select("doc_id", pii.listed(base).alias("spans")).collect()}
    assert got == {i: base_spans(t) for i, t in enumerate(texts)}
    assert hashlib.sha256(b"").hexdigest() == found.select(F.sha2(F.lit(""), 256)).first()[0]


def test_checksums_and_context(spark):
    rows = pii.find(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string")).collect()
    kinds = {r["doc_id"]: [(s["kind"], s["start"]) for s in r["pii"]] for r in rows}
    assert [k for k, _ in kinds[7]].count("iban") == 1
    assert [s for k, s in kinds[8] if k == "ssn"] == [4, 20]
    score = {r["doc_id"]: {s["start"]: s["score"] for s in r["pii"]} for r in rows}
    assert score[4][5] == 1.0


def test_mask(spark):
    docs = spark.createDataFrame(
        [(1, "mail a@b.cd now", 15, "r", 5), (2, None, None, None, None), (3, "plain", 5, "q", 1), (4, "+49 30 1234 5678 9012 3456", 26, "", 0)],
        "doc_id int, text string, n_chars int, row string, pii int")
    out = {r["doc_id"]: r for r in pii.mask(docs).collect()}
    assert pii.mask(docs).schema == docs.schema
    assert out[1]["text"] == "mail [EMAIL] now" and out[1]["n_chars"] == 16 and out[1]["row"] == "r" and out[1]["pii"] == 5
    assert out[2]["text"] is None and out[3]["text"] == "plain"
    assert pii.mask(docs.limit(0)).count() == 0


def masked(text, spans):
    out, at = [], 0
    for start, back, kind in sorted((s["start"], -s["stop"], s["kind"]) for s in spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, -back)
    return "".join(out) + text[at:]


def test_scores_and_mask_of_many_spans(spark):
    rng = random.Random(9)
    bits = ["a@b.c", "x4111111111111111@d.e", "4111111111111111", "1.2.3.4", "+49 30 1234567", "é", "mail ", "Call ", "card", "x" * 30, " ", ".", "\n",
            " 078-05-1120 ", " ssn", " GB82 WEST 1234 5698 7654 32 "]
    texts = ["".join(rng.choice(bits) for _ in range(n)) for n in (5, 40, 600, 2000, 3000)] + ["a@b.c " * n for n in (255, 256, 257, 512, 513)]
    texts += ["word " * 100_000 + "a@b.c", "ü@b.c " + "word " * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    words = {k.name: (k.score, re.compile(rf"(?i)(?<![a-z])(?:{k.words})")) for k in pii.KINDS}
    spans = {r["doc_id"]: r["pii"] for r in pii.find(docs).collect()}
    assert sum(map(len, spans.values())) > 3000
    base = lambda d: ",".join(f"{s['kind']}:{s['start']}:{s['stop']}" for s in spans[d] if s["kind"] not in ("iban", "ssn"))
    for d, text in enumerate(texts):
        assert base(d) == base_spans(text)
        for s in spans[d]:
            least, near = words[s["kind"]]
            assert s["score"] == min(1.0, least + (0.35 if near.search(text[max(0, s["start"] - 40) : s["start"]]) else 0.0))
    assert {r["doc_id"]: r["text"] for r in pii.mask(docs).collect()} == {d: masked(t, spans[d]) for d, t in enumerate(texts)}


def test_time_grows_with_the_spans(spark):
    text = "".join(f"write to user{i}@mail.example or " for i in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    begin = time.monotonic()
    spans = pii.find(docs).first()["pii"]
    found = time.monotonic()
    got = pii.mask(docs).first()["text"]
    print(found - begin, time.monotonic() - found)
    assert [(s["start"], s["stop"]) for s in spans] == [m.span() for m in re.finditer(r"user[0-9]+@mail\.example", text)]
    assert got == "write to [EMAIL] or " * 100_000
    assert time.monotonic() - begin < 120


@pytest.mark.parametrize("digits,good", [("4111111111111111", True), ("4111111111111112", False)])
def test_luhn(spark, digits, good):
    assert spark.range(1).select(pii.luhn(F.lit(digits))).first()[0] is good
