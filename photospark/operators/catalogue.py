"""Joins, merges, ordering and counts on candidate catalogues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photospark.functions import rules
from photospark.functions.labels import LABEL_MAPS
from photospark.functions.scalars import is_number, norm_code, strip_spaces
from photospark.plans.groups import MAX_GROUP_ROWS, group_quantiles, join_to_groups
from photospark.schema import CANDIDATE_KEY, SERIES_KEY

# ---- joins -----------------------------------------------------------------


def attach_series(candidates: DataFrame, series: DataFrame, max_rows: int | None = MAX_GROUP_ROWS) -> DataFrame:
    """Candidates with their cadences; a candidate without series stays, with ``has_series`` false.

    Series longer than ``max_rows`` are not gathered: their few candidates go to them.
    """
    keys = list(SERIES_KEY)
    joined, _ = join_to_groups(candidates, series.withColumn("has_series", F.lit(True)), keys, max_rows)
    alone = candidates.join(series.select(*keys).distinct(), keys, "left_anti").withColumn("has_series", F.lit(False))
    return joined.unionByName(alone, allowMissingColumns=True)


def series_available(candidates: DataFrame, series: DataFrame) -> DataFrame:
    """Candidates with a flag only: the series is reduced to its keys before the join."""
    keys = series.select(*SERIES_KEY).distinct().withColumn("has_series", F.lit(True))
    return candidates.join(keys, list(SERIES_KEY), "left").withColumn(
        "has_series", F.coalesce("has_series", F.lit(False))
    )


def attach_meta(candidates: DataFrame, meta: DataFrame, on: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Candidates with the star metadata; names already in the catalogue win."""
    extra = [c for c in meta.columns if c not in candidates.columns]
    return candidates.join(meta.select(*on, *extra), list(on), "left")


def first_label(dispositions: DataFrame, mapping: str = "tfop") -> DataFrame:
    """Class of the first disposition row of every star (``row_no`` gives the order)."""
    label = LABEL_MAPS[mapping](F.col("disposition"))
    return dispositions.groupBy("tic_id").agg(F.min_by(label, "row_no").alias("label"))


def attach_labels(catalogue: DataFrame, dispositions: DataFrame, mapping: str = "tfop") -> DataFrame:
    """Catalogue with a label per star; unusable labels are null."""
    labels = first_label(dispositions, mapping).withColumn("label", F.nullif("label", F.lit(-1)))
    return catalogue.drop("label").join(labels, "tic_id", "left")


def nearest_ld(
    meta: DataFrame, ld: DataFrame, default: tuple[float, float] = (0.3, 0.3), cell_kelvin: float = 50.0
) -> DataFrame:
    """Add u1 and u2 of the table row with the nearest ``teff``; ties go to the first row.

    Every table row owns the temperatures nearer to it than to its neighbours.
    Rows and stars meet through temperature cells, so this is an equi-join; a
    missing temperature gets the default. ``ld`` needs ``row_no`` for ties.
    """
    table = ld.groupBy("teff").agg(F.min_by(F.struct("row_no", "u1", "u2"), "row_no").alias("r"))
    ordered = Window.orderBy("teff")
    owned = table.select("teff", "r.*").select(
        "*",
        F.lag("teff").over(ordered).alias("_below"), F.lag("row_no").over(ordered).alias("_below_no"),
        F.lead("teff").over(ordered).alias("_above"), F.lead("row_no").over(ordered).alias("_above_no"),
    )
    limits = ld.agg(F.min("teff").alias("lo"), F.max("teff").alias("hi")).first()
    if limits is None or limits["lo"] is None:
        return meta.withColumns({"u1": F.lit(default[0]), "u2": F.lit(default[1])})
    cell_of = lambda t: F.floor(F.least(F.greatest(t, F.lit(limits["lo"])), F.lit(limits["hi"])) / cell_kelvin)
    first = F.coalesce((F.col("teff") + F.col("_below")) / 2.0, F.col("teff"))
    last = F.coalesce((F.col("teff") + F.col("_above")) / 2.0, F.col("teff"))
    cells = owned.withColumn("_cell", F.explode(F.sequence(cell_of(first), cell_of(last)))).withColumnRenamed("teff", "_t")
    star = F.when(is_number(F.col("teff")), F.col("teff"))
    left = meta.withColumn("_star", star).withColumn("_cell", cell_of(F.col("_star")))
    distance = F.abs(F.col("_star") - F.col("_t"))

    def nearer(other: str, other_no: str) -> Column:
        far = F.abs(F.col("_star") - F.col(other))
        return F.col(other).isNull() | (distance < far) | ((distance == far) & (F.col("row_no") < F.col(other_no)))

    match = (left["_cell"] == cells["_cell"]) & nearer("_below", "_below_no") & nearer("_above", "_above_no")
    return left.join(cells, match, "left").select(
        *[left[c] for c in meta.columns],
        F.coalesce("u1", F.lit(default[0])).alias("u1"), F.coalesce("u2", F.lit(default[1])).alias("u2"),
    )


def ld_lookup(candidates: DataFrame, catalogue: DataFrame, default: tuple[float, float] = (0.4, 0.2)) -> DataFrame:
    """Add ``ld_u1``/``ld_u2`` of the star; a missing star or a missing value gives the default pair."""
    table = catalogue.select(
        "tic_id", F.struct("ld_u1", "ld_u2").alias("_ld")
    ).filter(is_number(F.col("_ld.ld_u1")) & is_number(F.col("_ld.ld_u2")))
    return (
        candidates.join(table, "tic_id", "left")
        .withColumns({
            "ld_u1": F.coalesce("_ld.ld_u1", F.lit(default[0])), "ld_u2": F.coalesce("_ld.ld_u2", F.lit(default[1])),
        })
        .drop("_ld")
    )


def only_available(events: DataFrame, series: DataFrame, on: Sequence[str] = ("tic_id",)) -> DataFrame:
    """Events of stars that have a series."""
    return events.join(series.select(*on), list(on), "left_semi")


def pending(work: DataFrame, done: DataFrame, on: Sequence[str] = SERIES_KEY) -> DataFrame:
    """Work that is not in ``done``."""
    return work.join(done.select(*on), list(on), "left_anti")


def attach_results(catalogue: DataFrame, results: DataFrame, name: str, on: Sequence[str] = ("tic_id",)) -> DataFrame:
    """Attach optional results as a struct column, null where there are none."""
    fields = [c for c in results.columns if c not in on]
    packed = results.select(*on, F.struct(*fields).alias(name))
    return catalogue.join(packed, list(on), "left")


def best_model(catalogue: DataFrame, posterior: DataFrame, simplex: DataFrame) -> DataFrame:
    """Model parameters per star: converged posterior, else simplex fit, else none."""
    p = posterior.filter("mcmc_converged").select(
        "tic_id",
        F.struct(
            F.col("mcmc_rp_rs").alias("rp"), F.col("mcmc_inclination").alias("inc"), F.col("mcmc_a_rs").alias("a"),
            F.coalesce("mcmc_t0", F.lit(0.0)).alias("t0"), F.col("mcmc_period").alias("per"),
        ).alias("_p"),
    )
    s = simplex.select(
        "tic_id",
        F.struct(
            F.col("nm_rp_rs").alias("rp"), F.col("nm_inclination").alias("inc"), F.col("nm_a_rs").alias("a"),
            F.col("nm_t0").alias("t0"), F.col("nm_period").alias("per"),
        ).alias("_s"),
    )
    return (
        catalogue.join(p, "tic_id", "left").join(s, "tic_id", "left")
        .withColumn("model", F.coalesce("_p", "_s"))
        .withColumn(
            "model_source",
            F.when(F.col("_p").isNotNull(), "mcmc").when(F.col("_s").isNotNull(), "nelder_mead").otherwise("none"),
        )
        .drop("_p", "_s")
    )


def in_split(df: DataFrame, split: DataFrame, name: str, on: Sequence[str] = CANDIDATE_KEY) -> DataFrame:
    """Rows that belong to the named part of a saved split."""
    return df.join(split.filter(F.col("split") == name).select(*on), list(on), "left_semi")


def cross_grid(df: DataFrame, **grids: Sequence[float]) -> DataFrame:
    """Every row with every combination of the grid values, one column per grid.

    The grids are literals, so rows multiply in place without a join.
    """
    for name, values in grids.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def keyed_update(catalogue: DataFrame, updates: DataFrame, on: Sequence[str] = CANDIDATE_KEY) -> DataFrame:
    """Overwrite or add the columns of ``updates`` for its keys; other rows keep theirs or get null."""
    on = list(on)
    names = [c for c in updates.columns if c not in on]
    new = updates.select(*on, F.struct(*names).alias("_new"))
    joined = catalogue.join(new, on, "left")
    hit = F.col("_new").isNotNull()
    values = {
        n: F.when(hit, F.col(f"_new.{n}")).otherwise(F.col(n)) if n in catalogue.columns else F.col(f"_new.{n}")
        for n in names
    }
    return joined.withColumns(values).drop("_new")


def identifier_lookup(spark: SparkSession, basic: DataFrame, ident: DataFrame, name: str) -> DataFrame:
    """Objects known under an identifier: ``basic`` and ``ident`` share ``oid``."""
    return spark.sql(
        "SELECT b.* FROM {basic} b JOIN {ident} i ON b.oid = i.oidref WHERE i.id = {name}",
        basic=basic, ident=ident, name=name,
    )


def split_overlap(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups that occur in more than one part of a split, with the number of parts."""
    return (
        df.select(group, split).distinct().groupBy(group).agg(F.count(F.lit(1)).alias("n_splits")).filter("n_splits > 1")
    )


# ---- merges and sets ---------------------------------------------------------


def _merge(parts: Sequence[DataFrame], on: Sequence[str], order: Sequence[str], last: bool) -> DataFrame:
    """Union by name; per key the row of the earliest (or latest) part, ``order`` inside a part."""
    on = list(on)
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    union = tagged[0]
    for part in tagged[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    values = [c for c in union.columns if c not in (*on, "_part")]
    pick = F.max_by if last else F.min_by
    rank = F.struct("_part", *order)
    return union.groupBy(*on).agg(pick(F.struct(*values), rank).alias("_row")).select(*on, "_row.*")


def upsert(old: DataFrame, new: DataFrame, on: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Union of both, keeping the old row of a key that both have."""
    return _merge([old, new], on, order, last=False)


def merge_keep_last(parts: Sequence[DataFrame], on: Sequence[str] = SERIES_KEY, order: Sequence[str] = ()) -> DataFrame:
    """Union of sector catalogues; a key keeps the row of the latest part."""
    return _merge(parts, on, order, last=True)


merge_catalogues = merge_keep_last


def union_priority(primary: DataFrame, fallback: DataFrame, on: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``primary``, filled up with those keys of ``fallback`` it does not have."""
    return _merge([primary, fallback], on, order, last=False)


def invalid_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Distinct values of a column that are not allowed."""
    return df.select(column).filter(~F.col(column).isin(list(allowed)) | F.col(column).isNull()).distinct()


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def shared_groups(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values that both tables have; empty if a split does not leak."""
    return a.select(column).intersect(b.select(column))


def distinct_ids(df: DataFrame, column: str = "tic_id") -> DataFrame:
    return df.select(column).distinct()


# ---- order, pages, top-k -----------------------------------------------------


def _tie(df: DataFrame) -> list[Column]:
    return [F.col(c).asc() for c in CANDIDATE_KEY if c in df.columns]


def sort_by_sde(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("sde").desc_nulls_last(), *_tie(df))


def top_by_sde(df: DataFrame, n: int = 200, min_sde: float = 7.0) -> DataFrame:
    """The ``n`` most significant candidates at or above ``min_sde``."""
    return df.filter(is_number(F.col("sde")) & (F.col("sde") >= min_sde)).orderBy(F.col("sde").desc(), *_tie(df)).limit(n)


def top_by_score(df: DataFrame, n: int = 15) -> DataFrame:
    """Second gate, then the ``n`` highest products of significance and planet probability."""
    kept = df.filter(rules.gate2(F.col("sde"), F.col("prob_pc")))
    return kept.orderBy((F.col("sde") * F.col("prob_pc")).desc(), *_tie(df)).limit(n)


def rank_by(df: DataFrame, score: Column, n: int, name: str = "rank") -> DataFrame:
    """The ``n`` highest scores with their 1-based rank; only those rows are numbered."""
    top = df.withColumn("_score", score).orderBy(F.col("_score").desc(), *_tie(df)).limit(n)
    numbered = Window.orderBy(F.col("_score").desc(), *_tie(df))
    return top.withColumn(name, F.row_number().over(numbered)).drop("_score")


def head(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def best_of(df: DataFrame, keys: Sequence[str], score: str, columns: Sequence[str]) -> DataFrame:
    """Columns of the row with the highest score per key; ties go to the smallest columns."""
    negated = F.struct(*[(-F.col(c)).alias(c) for c in columns])
    best = F.max_by(F.struct(score, *columns), F.struct(F.col(score), negated.alias("tie")))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 20) -> DataFrame:
    """Page ``number`` (from 0) of the sorted table."""
    return df.orderBy(*order).offset(number * size).limit(size)


def search_candidates(df: DataFrame, text: str = "", tier: str = "ALL", id_column: str = "tic_id") -> DataFrame:
    """Rows whose id contains ``text`` (any case) and whose tier is ``tier``."""
    out = df.filter(F.lower(F.col(id_column).cast("string")).contains(text.lower())) if text else df
    return out if tier in ("", "ALL") else out.filter(F.col("confidence_tier") == tier)


def search_counts(df: DataFrame, text: str = "", tier: str = "ALL", id_column: str = "tic_id") -> DataFrame:
    """One row: how many rows match a search, out of how many."""
    hit = F.lower(F.col(id_column).cast("string")).contains(text.lower())
    if tier not in ("", "ALL"):
        hit = hit & (F.col("confidence_tier") == tier)
    return df.agg(F.count_if(hit).alias("filtered"), F.count(F.lit(1)).alias("total"))


def candidate_by_id(df: DataFrame, text: str, id_column: str = "tic_id") -> DataFrame:
    """Rows of one id; spaces in the id do not matter."""
    return df.filter(strip_spaces(F.col(id_column).cast("string")) == "".join(text.split()))


# ---- counts ------------------------------------------------------------------


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def sector_counts(work: DataFrame) -> DataFrame:
    return count_by(work, "sector")


def recent_counts(df: DataFrame, column: str, order: Sequence[Column], last: int = 100) -> DataFrame:
    """Counts of a column over the ``last`` rows in ``order`` (newest first)."""
    return count_by(df.orderBy(*order).limit(last), column)


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and percentage of the labelled rows for each of the four classes."""
    known = [F.count_if(F.col(label) == i).alias(f"_{i}") for i in range(4)]
    counts = df.agg(*known, F.count(label).alias("_n"))
    stacked = ", ".join(f"{i}, '{name}', _{i}" for i, name in enumerate(rules.CLASS_NAMES))
    return counts.selectExpr("_n", f"stack(4, {stacked}) AS (label, name, n)").select(
        "label", "name", "n",
        F.when(F.col("_n") > 0, F.lit(100.0) * F.col("n") / F.col("_n")).otherwise(F.lit(0.0)).alias("pct"),
    )


def kpi(catalogue: DataFrame, planet: str = "CONFIRMED_PLANET") -> DataFrame:
    """One row: candidates, gold tier, planets and mean significance (0 for an empty table)."""
    return catalogue.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("confidence_tier") == "GOLD").alias("gold"),
        F.count_if(F.col("disposition") == planet).alias("planets"),
        F.coalesce(F.avg("sde"), F.lit(0.0)).alias("avg_sde"),
    )


def tier_counts(catalogue: DataFrame) -> DataFrame:
    """One row: all, gold (>= 0.90) and silver (0.70 to 0.90) candidates."""
    p = F.col("prob_pc")
    known = is_number(p)
    return catalogue.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(known & (p >= rules.GOLD_CONFIDENCE)).alias("gold"),
        F.count_if(known & (p >= rules.SILVER_CONFIDENCE) & (p < rules.GOLD_CONFIDENCE)).alias("silver"),
    )


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int, clip: bool = False) -> DataFrame:
    """Counts in equal bins, empty ones included; the last bin takes its upper edge.

    Values outside are dropped, or moved to the edge bins with ``clip``.
    """
    x = F.col(column)
    if clip:
        x = F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))
    width = (high - low) / bins
    index = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    counted = (
        df.filter(is_number(F.col(column)) & x.between(low, high))
        .groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )
    spine = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"), (F.lit(float(low)) + F.col("id") * width).alias("bin_start")
    )
    return spine.join(counted, "bin", "left").select("bin", "bin_start", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def describe_features(df: DataFrame, columns: Sequence[str], max_rows: int | None = MAX_GROUP_ROWS) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of every feature, one row each."""
    stacked = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    long = df.selectExpr(f"stack({len(columns)}, {stacked}) AS (feature, x)").filter("x is not null and not isnan(x)")
    x = F.col("x")
    table = group_quantiles(
        long, ["feature"], {"p25": (x, 0.25), "p50": (x, 0.5), "p75": (x, 0.75)}, max_rows,
        {"n": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)},
    )
    return table.select("feature", "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def tally(df: DataFrame, column: str, value) -> DataFrame:
    """One row: how many rows have ``value``, out of how many."""
    return df.agg(F.count_if(F.col(column) == F.lit(value)).alias("n"), F.count(F.lit(1)).alias("total"))


# ---- column names ------------------------------------------------------------

# Canonical name -> names under which it may arrive, best first.
COLUMN_ALIASES = {
    "tic_id": ("tic_id", "TIC_ID", "ticid", "TIC ID", "TIC", "tid"),
    "sector": ("sector",),
    "period": ("period", "tls_period", "Period (days)", "Period", "pl_orbper"),
    "t0": ("t0", "tls_t0", "Epoch (BJD)", "Epoch", "epoch", "pl_tranmid"),
    "sde": ("sde", "tls_sde"),
    "snr": ("snr", "tls_snr"),
    "depth": ("depth", "tls_depth"),
    "duration": ("duration", "tls_duration"),
}
DISPOSITION_ALIASES = (
    "TFOPWG Disposition", "tfopwg_disp", "ACWG Disposition", "disposition", "Disposition",
)


def find_column(columns: Sequence[str], options: Sequence[str]) -> str | None:
    """First option that is present, exactly or else in any case."""
    for option in options:
        if option in columns:
            return option
    lower = {c.lower(): c for c in columns}
    for option in options:
        if option.lower() in lower:
            return lower[option.lower()]
    return None


def resolve_columns(
    df: DataFrame, aliases: dict[str, Sequence[str]] = COLUMN_ALIASES
) -> tuple[DataFrame, list[str]]:
    """Rename known columns to their canonical names; also returns the names that are missing."""
    renames, missing = {}, []
    for name, options in aliases.items():
        found = find_column(df.columns, options)
        if found is None:
            missing.append(name)
        elif found != name:
            renames[found] = name
    return df.withColumnsRenamed(renames), missing


def tidy_dispositions(df: DataFrame) -> DataFrame:
    """Canonical ``tic_id`` and ``disposition`` columns; without one, every listed object is a candidate."""
    tic = find_column(df.columns, COLUMN_ALIASES["tic_id"])
    if tic is None:
        raise ValueError(f"no identifier column among {df.columns}")
    found = find_column(df.columns, DISPOSITION_ALIASES)
    if found is None and find_column(df.columns, ("TOI",)) is None:
        raise ValueError(f"no disposition column among {df.columns}")
    text = F.col(f"`{found}`").cast("string") if found else F.lit("PC")
    others = [F.col(f"`{c}`") for c in df.columns if c not in (tic, found)]
    number = F.col(f"`{tic}`").cast("string").try_cast("double").cast("bigint")
    return df.select(number.alias("tic_id"), text.alias("disposition"), *others).filter("tic_id is not null")


def code_counts(dispositions: DataFrame, n: int = 15) -> DataFrame:
    """The most frequent disposition codes."""
    return (
        dispositions.groupBy(norm_code(F.col("disposition")).alias("code")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "code").limit(n)
    )
