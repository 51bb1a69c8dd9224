"""Quality rules on whole texts and robust multivariate outliers, in DataFrame functions only.

Rules are counted per text with array functions. The outlier step describes each
text by four transformed statistics and estimates, per language and source, the
minimum-covariance-determinant location and scatter: start from median and
quartile range, then repeat concentration steps (keep the ``SUPPORT`` share with
the smallest Mahalanobis distance, estimate again). The estimate of a source is
drawn towards that of its language by a weight that grows smoothly with its
documents; nothing is borrowed from other languages. Statistics are fixed-point
integers, so every sum is exact and the verdict does not depend on how the rows
are dealt to tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photospark.llm.scratch import keep, keyed, small

WORD_GAP = r"[\x20\x09-\x0D]+"
STATS = ("z_length", "z_symbol", "z_upper", "z_punct")
#: Share of a group on which the scatter is estimated.
SUPPORT = 0.75
#: Factor that makes the scatter of the inner 75 % of a 4-variate normal consistent.
CONSISTENCY = 1.485
#: Concentration steps; each lowers the determinant, and few are needed from a robust start.
STEPS = 3
#: What the estimate of its language weighs in that of a source, in documents.
PRIOR = 50
#: Squared distance beyond which a document is rejected (ten robust deviations).
CUT = 100.0
#: Fixed-point unit of the statistics, and the least deviation of each (keeps a constant statistic invertible).
UNIT = 1000
FLOOR = 40


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def words_of(text: Column) -> Column:
    """The words (runs without ASCII white space) of a text."""
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def _repeated_words(words: Column, n: Column) -> Column:
    """Words inside 5-word windows whose words occur twice or more in the text."""
    grams = F.when(
        n >= 5,
        F.transform(F.sequence(F.lit(0), F.greatest(n - 5, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)])),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(starts):
        zero = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(
            starts, zero,
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(5), i - acc["last"])).alias("n")), lambda acc: acc["n"],
        )

    def count(g):
        ordered = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = bind(ordered, lambda s: F.filter(
            F.transform(s, lambda x, k: F.when(
                (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])),
            lambda i: i.isNotNull(),
        ))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(covered(F.sort_array(twice)))

    return bind(grams, count)


def text_rules(docs: DataFrame) -> DataFrame:
    """One row per document: the rule counts, ``base_failed`` and the fixed-point statistics.

    A null text is an empty one (no words, fails). Null languages and sources
    are groups of their own. Columns other than ``doc_id, text, lang, source``
    are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text.alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text"))).withColumn("n", F.size("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, " \t\x0b\f\r", "")) > 0)
    solid = F.array_join("words", "")
    rows = rows.select(
        "doc_id", "lang", "source", F.col("n").cast("bigint").alias("n_words"),
        F.length(solid).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        _repeated_words(F.col("words"), F.col("n")).cast("bigint").alias("n_repeat_words"),
        F.regexp_count("text", F.lit("[A-Z]")).alias("_upper"),
        F.regexp_count("text", F.lit(r"[!-/:-@\[-`{-~]")).alias("_punct"),
    )

    def share(column: str) -> Column:
        return F.sqrt(F.col(column) / F.greatest("word_chars", F.lit(1)))

    fixed = {
        "z_length": F.log(F.greatest("word_chars", F.lit(1)) / F.greatest("n_words", F.lit(1))),
        "z_symbol": share("n_symbols"), "z_upper": share("_upper"), "z_punct": share("_punct"),
    }
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), *[F.round(v * UNIT).cast("bigint").alias(k) for k, v in fixed.items()],
    )


def _own() -> Column:
    return F.concat(F.length("lang").cast("string"), F.lit(":"), "lang", "source")


def _language() -> Column:
    return F.concat(F.lit("*"), "lang")


def _start(rows: DataFrame) -> DataFrame:
    """Median and quartile range of each statistic per group, from the counts of its values."""
    tall = rows.select("grp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v")) for i, c in enumerate(STATS)])).alias("x"))
    counts = tall.groupBy("grp", "x.i", "x.v").agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy("grp", "i")
    ranked = counts.select("grp", "i", "v", F.sum("c").over(group.orderBy("v")).alias("upto"), F.sum("c").over(group).alias("n"))

    def at(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= F.col("n") * q, F.col("v")))

    spread = ranked.groupBy("grp", "i").agg(at(0.5).alias("m"), ((at(0.75) - at(0.25)) / 1.349).alias("s"))

    def of(i: int, column: str) -> Column:
        return F.max(F.when(F.col("i") == i, F.col(column))).cast("double")

    p = range(len(STATS))
    wide = spread.groupBy("grp").agg(*[of(i, "m").alias(f"m{i}") for i in p], *[of(i, "s").alias(f"s{i}") for i in p])
    return wide.select("grp", *[f"m{i}" for i in p], *[
        (F.col(f"s{i}") * F.col(f"s{i}") + FLOOR * FLOOR if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in p for j in p if j <= i])


def _distance(rows: DataFrame, model: DataFrame, how: str = "inner") -> DataFrame:
    """Squared Mahalanobis distance by a Cholesky factor written out in columns; null where a left join finds no model."""
    out = rows.join(small(model), "grp", how)
    p = range(len(STATS))
    for j in p:
        for i in p:
            if i >= j:
                value = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
                out = out.withColumn(f"l{i}{j}", F.sqrt(value) if i == j else value / F.col(f"l{j}{j}"))
    for i in p:
        value = F.col(STATS[i]) - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"y{i}", value / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in p), F.lit(0.0))
    return out.select(*rows.columns, d2.alias("d2"))


def _concentrate(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One concentration step: the ``SUPPORT`` share nearest to the centre gives the next centre and scatter."""
    near = _distance(rows, model).withColumn("bin", F.least(F.floor(F.col("d2") * 64), F.lit(1 << 20)))
    counts = near.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy("grp")
    upto = counts.select("grp", "bin", F.sum("c").over(group.orderBy("bin")).alias("upto"), F.sum("c").over(group).alias("n"))
    cut = keep(upto.filter(F.col("upto") >= F.col("n") * SUPPORT).groupBy("grp").agg(F.min("bin").alias("cut")), "mcd-cut")
    p = range(len(STATS))
    kept = near.join(small(cut), "grp").filter(F.col("bin") <= F.col("cut"))
    sums = kept.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(STATS[i]).alias(f"t{i}") for i in p],
        *[F.sum((F.col(STATS[i]) * F.col(STATS[j])).cast("decimal(20,0)")).alias(f"q{i}{j}") for i in p for j in p if j <= i],
    )
    mean = sums.select("*", *[(F.col(f"t{i}") / F.col("n")).alias(f"m{i}") for i in p])
    return keep(mean.select("grp", *[f"m{i}" for i in p], *[
        (CONSISTENCY * (F.col(f"q{i}{j}").cast("double") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) + (FLOOR * FLOOR if i == j else 0.0)).alias(f"c{i}{j}")
        for i in p for j in p if j <= i]), "mcd")


def _shrunk(groups: DataFrame, model: DataFrame) -> DataFrame:
    """Centre and scatter of each source, drawn towards its language; no row where the language has too few documents for an estimate.

    A scatter of ``p`` statistics needs more than ``p`` documents in the inner
    share. A source with ``x`` more than that weighs ``x`` against ``PRIOR``, and
    the scatter takes in the offset between the two centres, as that of a
    mixture does. Scatters are widened by what the documents of the language
    are short of (the factor of Hotelling's distance of a new observation).
    """
    p = range(len(STATS))
    pairs = [(i, j) for i in p for j in p if j <= i]
    names = [f"m{i}" for i in p] + [f"c{i}{j}" for i, j in pairs]
    sizes = groups.groupBy("language").agg(F.sum("n").alias("n_language"))
    own = model.select(F.col("grp").alias("own"), *[F.col(c).alias(f"own_{c}") for c in names])
    whole = model.select(F.col("grp").alias("language"), *[F.col(c).alias(f"whole_{c}") for c in names])
    more = F.greatest(SUPPORT * F.col("n") - len(STATS), F.lit(0.0))
    rows = groups.join(small(sizes), "language").join(small(own), "own").join(small(whole), "language")
    rows = rows.withColumn("w", more / (more + PRIOR)).withColumn("sure", 1 - len(STATS) / (SUPPORT * F.col("n_language"))).filter("sure > 0")

    def mixed(c: str) -> Column:
        return F.col("w") * F.col(f"own_{c}") + (1 - F.col("w")) * F.col(f"whole_{c}")

    def apart(i: int) -> Column:
        return F.col(f"own_m{i}") - F.col(f"whole_m{i}")

    return rows.select(F.col("own").alias("grp"), *[mixed(f"m{i}").alias(f"m{i}") for i in p], *[
        ((mixed(f"c{i}{j}") + F.col("w") * (1 - F.col("w")) * apart(i) * apart(j)) / F.col("sure")).alias(f"c{i}{j}") for i, j in pairs])


def quality(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """``text_rules`` with ``distance2`` (null where the rules failed already) and ``kept``.

    A document is kept if the rules pass and its robust distance from its
    language and source is at most ``cut`` squared deviations. The fewer
    documents a source has, the more its estimate is that of its language
    (``_shrunk``). Where a language has too few documents for an estimate (5 that
    pass the rules), they are kept and ``distance2`` is null. Runs small
    jobs while it is built: the statistics are written once, the estimates are
    a row per group. An empty table gives an empty one.
    """
    rules = keep(text_rules(docs), "quality")
    passed = rules.filter(~F.col("base_failed")).withColumn("grp", _own())
    groups = keep(passed.groupBy(F.col("grp").alias("own"), _language().alias("language")).agg(F.count(F.lit(1)).alias("n")), "mcd-groups")
    fit = passed.withColumn("grp", F.explode(F.array("grp", _language()))).select("grp", *STATS)
    model = keep(_start(fit), "mcd-start")
    for _ in range(STEPS):
        model = _concentrate(fit, model)
    scored = _distance(passed, keep(_shrunk(groups, model), "mcd-shrunk"), "left")
    names = [c for c in rules.columns if c not in STATS]
    kept = scored.select(*names, F.col("d2").alias("distance2"), F.coalesce(F.col("d2") <= cut, F.lit(True)).alias("kept"))
    lost = rules.filter("base_failed").select(*names, F.lit(None).cast("double").alias("distance2"), F.lit(False).alias("kept"))
    return kept.unionByName(lost)


def keep_good(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents that ``quality`` keeps, all columns of ``docs``; each row by its own verdict, also where ids are null or repeated."""
    rows = keyed(docs)
    good = quality(rows, cut).filter("kept").select("doc_id")
    return rows.join(good, "doc_id", "left_semi").select(*[F.col("row")[c].alias(c) for c in docs.columns])
