"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

DataFrame functions only. Spans of a pattern come from the pieces between its
matches, so each pattern is run once over a text and a second time only where
it matched. A kind is proposed by a pattern, confirmed by a check, and scored:
a start value, raised when a word that goes with the kind stands in the
``NEAR`` characters before the span. Kinds of weak patterns count only with
such a word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photospark.llm.quality import bind

#: Characters before a span in which a context word counts, and what it adds to the score.
NEAR = 40
CONTEXT = 0.35
#: Spans with a lower score are dropped.
LEAST = 0.5
#: Spans that are worked on at a time within a text.
CHUNK = 256
SPANS = "array<struct<kind:string,start:int,stop:int,score:double>>"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data: pattern, a literal every match contains, start score, context words."""

    name: str
    pattern: str
    cue: str
    score: float
    words: str


#: Base kinds in their order. The patterns match what the plain ones do (``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`` and so
#: on), but start a run of their characters once and never give any back, so that time and stack stay bounded on long runs.
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, r"ip|server|host|address"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.8, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|call|tel|mobile|fax"),
)
ADDED = (
    Kind("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", "", 0.8, "iban|account|bank|konto"),
    Kind("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "-", 0.2, "ssn|social security"),
)
KINDS = BASE + ADDED


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn checksum."""
    def add(total, i):
        d = F.ascii(F.substring(F.reverse(digits), i, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code (letters and digits, country first) leaves 1 when divided by 97."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(rest, i):
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, rest * 100 + c - 55).otherwise(rest * 10 + c - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _confirmed(kind: Kind, match: Column) -> Column:
    if kind.name == "ip":
        return F.forall(F.split(match, r"\."), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))
    if kind.name == "card":
        d = _digits(match)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False)
    if kind.name == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind.name == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    return F.lit(True)


def _chunks(items: Column) -> Column:
    """An array as arrays of ``CHUNK`` items, so that what a step appends to stays short."""
    return bind(items, lambda x: F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.size(x) - 1, F.lit(0)) / CHUNK).cast("int")), lambda c: F.slice(x, c * CHUNK + 1, F.lit(CHUNK))))


def _spans(kind: Kind, text: Column, found: Column) -> Column:
    """Confirmed spans of one kind, left to right, as (kind, start, stop, score).

    One pass over the pieces between the matches, which carries the place and
    the ``NEAR`` characters before it; time grows with the text and its matches.
    """
    steps = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), found.alias("match"))

    def move(acc, x):
        def step(near):
            start = acc["at"] + F.length(x["gap"])
            stop = start + F.length(x["match"])
            score = F.lit(kind.score) + F.when(near.rlike(f"(?i)(?<![a-z])(?:{kind.words})"), CONTEXT).otherwise(0.0)
            span = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), stop.alias("stop"), F.least(score, F.lit(1.0)).alias("score"))
            return F.struct(
                stop.alias("at"), F.right(F.concat(near, x["match"]), F.lit(NEAR)).alias("near"),
                F.when(_confirmed(kind, x["match"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.when(x["match"].isNull(), acc).otherwise(bind(F.right(F.concat(acc["near"], x["gap"]), F.lit(NEAR)), step))

    none = F.array().cast(SPANS)

    def through(acc, chunk):
        begin = F.struct(acc["at"].alias("at"), acc["near"].alias("near"), none.alias("out"))
        return bind(F.aggregate(chunk, begin, move), lambda end: F.struct(
            end["at"].alias("at"), end["near"].alias("near"), F.concat(acc["outs"], F.array(end["out"])).alias("outs")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("near"), F.array().cast(f"array<{SPANS}>").alias("outs"))
    spans = F.aggregate(_chunks(steps), start, through, lambda acc: F.flatten(acc["outs"]))
    return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= LEAST)


def _found(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), text (null: empty) and pii."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    for i, kind in enumerate(KINDS):
        cue = F.contains("text", F.lit(kind.cue)) if kind.cue else F.col("text").rlike("[0-9]")
        rows = rows.withColumn(f"m{i}", F.when(cue, F.regexp_extract_all("text", F.lit(kind.pattern), 0)).otherwise(none))
    empty = F.array().cast(SPANS)
    spans = [F.when(F.size(f"m{i}") > 0, _spans(kind, F.col("text"), F.col(f"m{i}"))).otherwise(empty) for i, kind in enumerate(KINDS)]
    return rows.select("row", "text", F.concat(*spans).alias("pii"))


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii``: an array of spans (kind, start, stop, score) in the order of ``KINDS``.

    Positions are code points, stops exclusive. Base kinds are complete
    whatever their score; added kinds need ``LEAST``. A null text has no spans.
    A column ``pii`` that is there already is replaced. No shuffle.
    """
    return _found(docs).select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "pii"], "pii")


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:stop``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets; overlapping spans become one, named after the first.

    Null texts stay null, ``n_chars``, if there is one, follows a changed text,
    and other columns stay as they are.
    """
    ordered = F.sort_array(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s["kind"].alias("kind"))))

    def put(base, part):
        def step(acc, s):
            before = F.substring(part, acc["at"] - base + 1, s["start"] - acc["at"])
            return F.struct(
                F.greatest(acc["at"], -s["back"]).alias("at"),
                F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(
                    acc["out"], F.array(F.concat(before, F.lit("["), F.upper(s["kind"]), F.lit("]"))))).alias("out"))

        return step

    words = F.array().cast("array<string>")

    def through(acc, chunk):
        # ``rest`` is the text from ``base`` on; the spans of the chunk need it up to the start of the last
        last = F.element_at(chunk, -1)["start"]
        begin = F.struct(acc["at"].alias("at"), words.alias("out"))
        done = bind(F.substring(acc["rest"], F.lit(1), last - acc["base"]), lambda part: F.aggregate(chunk, begin, put(acc["base"], part)))
        return bind(done, lambda end: F.struct(
            end["at"].alias("at"), last.alias("base"), F.substring(acc["rest"], last - acc["base"] + 1, F.length(acc["rest"])).alias("rest"),
            F.concat(acc["outs"], F.array(F.array_join(end["out"], ""))).alias("outs")))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("base"), F.col("text").alias("rest"), words.alias("outs"))
    masked = F.aggregate(_chunks(ordered), start, through, lambda acc: F.concat(
        F.array_join(acc["outs"], ""), F.substring(acc["rest"], acc["at"] - acc["base"] + 1, F.length(acc["rest"]))))
    rows = _found(docs).withColumn("masked", F.when(F.size("pii") > 0, masked))
    new = {"text": F.coalesce("masked", F.col("row")["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("masked").isNotNull(), F.length("masked")).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
