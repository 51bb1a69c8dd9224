"""Evaluation, calibration, training data, classifiers, posteriors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from photospark.operators import calibrate, evaluate, fold, learn, posterior
from photospark.plans.lineage import pin
from verification import views
from verification.registry import query, rounded, sql_r6, table
from verification.rule_queries import _T14
from verification.views import with_views

PRED = with_views("pred")


@query(
    "ag15_confusion",
    PRED + "SELECT CAST(i AS BIGINT) AS label, " + ", ".join(f"count(*) FILTER (WHERE pred = {j}) AS pred_{j}" for j in range(4))
    + " FROM range(4) r(i) LEFT JOIN pred ON pred.label = r.i GROUP BY i",
)
def _(spark, sf):
    return rounded(evaluate.confusion(views.pred(spark, sf)))


def _rates_sql(source, y, p):
    return (
        f"SELECT count(*) AS n, count(*) FILTER (WHERE {y} = {p}) / count(*)::DOUBLE AS accuracy, "
        f"coalesce(count(*) FILTER (WHERE {y} = 0 AND {p} = 0) / nullif(count(*) FILTER (WHERE {y} = 0), 0)::DOUBLE, 0.0) AS planet_recall, "
        f"coalesce(count(*) FILTER (WHERE {y} = 0 AND {p} = 0) / nullif(count(*) FILTER (WHERE {p} = 0), 0)::DOUBLE, 0.0) AS planet_precision, "
        f"coalesce(count(*) FILTER (WHERE {y} <> 0 AND {p} = 0) / nullif(count(*) FILTER (WHERE {y} <> 0), 0)::DOUBLE, 0.0) AS fpr FROM {source}"
    )


@query(
    "ag16_binary_gates",
    f"WITH r AS ({_rates_sql('labels', 'quality', 'toxic')}) SELECT n, {', '.join(sql_r6(c) + ' AS ' + c for c in ('accuracy', 'planet_recall', 'planet_precision', 'fpr'))}, "
    "accuracy >= 0.9 AS accuracy_pass, planet_recall >= 0.85 AS planet_recall_pass, planet_precision >= 0.8 AS planet_precision_pass, fpr <= 0.1 AS fpr_pass, "
    "CAST(CASE WHEN accuracy < 0.9 OR planet_recall < 0.85 THEN 1 WHEN planet_precision < 0.8 OR fpr > 0.1 THEN 2 ELSE 0 END AS BIGINT) AS severity FROM r",
)
def _(spark, sf):
    return rounded(evaluate.binary_gates(evaluate.binary_rates(table(spark, sf, "labels"), "quality", "toxic")))


_REPORT = """rep AS (SELECT i AS label, CASE i WHEN 0 THEN 'PC' WHEN 1 THEN 'EB' WHEN 2 THEN 'Blend' ELSE 'StellarVar' END AS name,
  (SELECT count(*) FROM pred WHERE label = i AND pred = i) AS tp, (SELECT count(*) FROM pred WHERE pred = i) AS h, (SELECT count(*) FROM pred WHERE label = i) AS support FROM range(4) r(i)),
rep2 AS (SELECT *, coalesce(tp / nullif(h, 0)::DOUBLE, 0.0) AS precision, coalesce(tp / nullif(support, 0)::DOUBLE, 0.0) AS recall FROM rep),
rep3 AS (SELECT *, coalesce(precision * recall * 2.0 / nullif(precision + recall, 0), 0.0) AS f1 FROM rep2)"""


@query("ag17_class_report", PRED + f", {_REPORT} SELECT CAST(label AS BIGINT) AS label, name, {sql_r6('precision')} AS precision, {sql_r6('recall')} AS recall, {sql_r6('f1')} AS f1, support FROM rep3")
def _(spark, sf):
    return rounded(evaluate.class_report(views.pred(spark, sf)))


@query("ag17_macro_f1", PRED + f", {_REPORT} SELECT {sql_r6('avg(f1)')} AS f1_macro FROM rep3 WHERE support > 0 OR f1 > 0")
def _(spark, sf):
    return rounded(evaluate.macro_f1(evaluate.class_report(views.pred(spark, sf))))


_CAL = """cal AS (SELECT CAST(ceil(list_max(probs) * 10) - 1 AS BIGINT) AS bin, count(*) AS n, sum(list_max(probs)) AS conf,
  sum(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS ok FROM pred GROUP BY 1)"""


@query(
    "ag18_calibration",
    PRED + f", {_CAL} SELECT CAST(i AS BIGINT) AS bin, {sql_r6('(i + 0.5::DOUBLE) / 10')} AS bin_center, {sql_r6('coalesce(ok / n, 0.0)')} AS accuracy, "
    f"{sql_r6('coalesce(conf / n, 0.0)')} AS confidence, coalesce(n, 0) AS count FROM range(10) r(i) LEFT JOIN cal ON cal.bin = r.i",
)
def _(spark, sf):
    return rounded(evaluate.calibration(views.pred(spark, sf)))


@query("ag18_calibration_error", PRED + f", {_CAL} SELECT {sql_r6('sum(abs(ok - conf)) / sum(n)')} AS ece FROM cal")
def _(spark, sf):
    return rounded(evaluate.expected_calibration_error(views.pred(spark, sf)))


_AUC = """sc AS (SELECT unnest(range(4)) AS k, unnest(probs) AS s, label FROM pred),
rk AS (SELECT k, label = k AS pos, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2.0 AS r FROM sc),
au AS (SELECT k, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS q, sum(r) FILTER (WHERE pos) AS sr FROM rk GROUP BY k),
auc AS (SELECT k, p, q, CASE WHEN p > 0 AND q > 0 THEN (sr - p * (p + 1) / 2.0) / (p::DOUBLE * q) END AS auc FROM au)"""


@query("ag19_roc_auc_ovr", PRED + f", {_AUC} SELECT k AS label_class, p AS n_pos, q AS n_neg, {sql_r6('auc')} AS auc FROM auc")
def _(spark, sf):
    return rounded(evaluate.roc_auc_ovr(views.pred(spark, sf)))


@query("ag19_macro_auc", PRED + f", {_AUC} SELECT {sql_r6('CASE WHEN count(auc) = count(*) THEN avg(auc) END')} AS roc_auc FROM auc")
def _(spark, sf):
    return rounded(evaluate.macro_auc(evaluate.roc_auc_ovr(views.pred(spark, sf))))


@query(
    "ag20_class_weights",
    with_views("view64") + ", c AS (SELECT label, count(*) AS n FROM view64 GROUP BY label), t AS (SELECT sum(n) AS tot, count(*) AS k FROM c) "
    f"SELECT CAST(i AS BIGINT) AS label, coalesce(n, 0) AS n, {sql_r6('CASE WHEN n > 0 THEN tot::DOUBLE / (k * n) ELSE 1.0 END')} AS weight "
    "FROM range(4) r(i) CROSS JOIN t LEFT JOIN c ON c.label = r.i",
)
def _(spark, sf):
    return rounded(evaluate.class_weights(views.view64(spark, sf)))


@query(
    "dm24_evaluate",
    PRED + f", {_REPORT}, {_CAL}, {_AUC}, r AS ({_rates_sql('pred', 'label', 'pred')}), e AS (SELECT sum(abs(ok - conf)) / sum(n) AS ece FROM cal), "
    "f AS (SELECT avg(f1) AS f1_macro FROM rep3 WHERE support > 0 OR f1 > 0), a AS (SELECT CASE WHEN count(auc) = count(*) THEN avg(auc) END AS roc_auc FROM auc) "
    f"SELECT n, {', '.join(sql_r6(c) + ' AS ' + c for c in ('accuracy', 'planet_recall', 'planet_precision', 'fpr', 'ece', 'f1_macro', 'roc_auc'))}, "
    "accuracy >= 0.9 AS accuracy_pass, planet_recall >= 0.85 AS planet_recall_pass, planet_precision >= 0.8 AS planet_precision_pass, fpr <= 0.1 AS fpr_pass, ece <= 0.04 AS ece_pass, "
    "CAST(CASE WHEN accuracy < 0.9 OR planet_recall < 0.85 OR ece > 0.04 THEN 1 WHEN planet_precision < 0.8 OR fpr > 0.1 THEN 2 ELSE 0 END AS BIGINT) AS severity FROM r, e, f, a",
)
def _(spark, sf):
    return rounded(evaluate.evaluate(views.pred(spark, sf)))


# ---- ensemble and temperature -----------------------------------------------------


def _blend_sql(blend):
    if blend == "log":
        return "[" + ", ".join(f"0.6::DOUBLE * ln(cnn[{i}] + 1e-10) + 0.4::DOUBLE * ln(xgb[{i}] + 1e-10)" for i in range(1, 5)) + "]"
    return "[" + ", ".join(f"ln(least(greatest(0.6::DOUBLE * cnn[{i}] + 0.4::DOUBLE * xgb[{i}], 1e-10), 1.0))" for i in range(1, 5)) + "]"


def _ensemble_sql(blend, t):
    return PRED + f""", lg AS (SELECT vec_id, label, crowdsap, {_blend_sql(blend)} AS z FROM pred),
ex AS (SELECT *, list_transform(z, lambda x: exp((x - list_max(z)) / {t}::DOUBLE)) AS e FROM lg),
sm AS (SELECT *, list_transform(e, lambda x: x / list_sum(e)) AS p FROM ex),
gt AS (SELECT *, crowdsap < 0.5::DOUBLE AND list_position(p, list_max(p)) = 1 AS blocked, p[2] + p[3] + p[4] + 1e-10 AS rest FROM sm),
fin AS (SELECT vec_id, CASE WHEN blocked THEN [0.0, p[2] / rest, p[3] / rest, p[4] / rest] ELSE p END AS p FROM gt)
SELECT vec_id, {sql_r6('p[1]')} AS prob_pc, {sql_r6('p[2]')} AS prob_eb, {sql_r6('p[3]')} AS prob_blend, {sql_r6('p[4]')} AS prob_sv,
CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS predicted_class, CASE WHEN p[1] > 0.9::DOUBLE THEN 'GOLD' WHEN p[1] > 0.7::DOUBLE THEN 'SILVER' ELSE 'BRONZE' END AS confidence_tier FROM fin"""


def _ensemble(spark, sf, blend, t):
    out = calibrate.ensemble(views.pred(spark, sf), temperature=t, blend=blend)
    return rounded(out.select("vec_id", "prob_pc", "prob_eb", "prob_blend", "prob_sv", "predicted_class", "confidence_tier"))


@query("dm12_ensemble_log", _ensemble_sql("log", 0.4))
def _(spark, sf):
    return _ensemble(spark, sf, "log", 0.4)


@query("dm12_ensemble_linear", _ensemble_sql("linear", 1.5))
def _(spark, sf):
    return _ensemble(spark, sf, "linear", 1.5)


def _fit_sql(objective):
    first = ", ".join(f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(calibrate.first_temperatures(0.01 if objective == "nll" else 0.1, 10.0)))
    blend = "log" if objective == "nll" else "linear"
    if objective == "nll":
        loss = "SELECT i, t, avg(ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / t)))) - (z[label + 1] - list_max(z)) / t) AS loss FROM lg, {grid} GROUP BY i, t"
    else:
        loss = (
            "SELECT i, t, sum(abs(ok - conf)) / sum(n) AS loss FROM (SELECT i, t, ceil(top * 10) AS b, count(*) AS n, sum(top) AS conf, "
            "sum(CASE WHEN list_position(z, list_max(z)) - 1 = label THEN 1.0 ELSE 0.0 END) AS ok FROM (SELECT i, t, z, label, "
            "1.0 / list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / t))) AS top FROM lg, {grid}) GROUP BY ALL) GROUP BY i, t"
        )
    text = PRED + f", lg AS (SELECT label, {_blend_sql(blend)} AS z FROM pred), g0 AS (SELECT * FROM (VALUES {first}) v(i, t))"
    for k in range(3):
        text += f", l{k} AS ({loss.format(grid=f'g{k}')}), b{k} AS (SELECT arg_min(i, {{'l': loss, 't': t}}) AS i, arg_min(t, {{'l': loss, 't': t}}) AS t, min(loss) AS loss FROM l{k})"
        if k < 2:
            text += (
                f", n{k} AS (SELECT (SELECT t FROM g{k} WHERE i = greatest(b.i - 1, 0)) AS lo, (SELECT t FROM g{k} WHERE i = least(b.i + 1, 40)) AS hi FROM b{k} b), "
                f"g{k + 1} AS (SELECT r.i, lo + r.i * ((hi - lo) / 40) AS t FROM n{k}, range(41) r(i))"
            )
    return text + f" SELECT {sql_r6('t', 4)} AS temperature, {sql_r6('loss', 4)} AS loss FROM b2"


@query("dm13_fit_temperature_nll", _fit_sql("nll"))
def _(spark, sf):
    df = views.pred(spark, sf).withColumn("logits", calibrate.ensemble_logits(F.col("cnn"), F.col("xgb")))
    return rounded(calibrate.fit_temperature(df, "nll"), 4)


@query("dm13_fit_temperature_ece", _fit_sql("ece"))
def _(spark, sf):
    df = views.pred(spark, sf).withColumn("logits", calibrate.ensemble_logits(F.col("cnn"), F.col("xgb"), blend="linear"))
    return rounded(calibrate.fit_temperature(df, "ece"), 4)


# ---- training data ----------------------------------------------------------------


def draw_sql(stream, *key, seed=42):
    return f"('0x' || substr(md5(concat_ws(':', '{stream}', '{seed}', {', '.join(key)})), 1, 13))::BIGINT"


def uniform_sql(stream, *key, seed=42):
    return f"(({draw_sql(stream, *key, seed=seed)} + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"


@query(
    "dm14_group_split",
    with_views("cand") + f""", n AS (SELECT tic_id, predicted_class AS label, count(*) AS n FROM cand WHERE predicted_class >= 0 GROUP BY ALL),
d AS (SELECT tic_id, arg_max(label, {{'n': n, 'l': -label}}) AS label FROM n GROUP BY tic_id),
o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {draw_sql('split', 'tic_id')}, tic_id) AS pos, count(*) OVER (PARTITION BY label) AS size FROM d)
SELECT tic_id, CAST(label AS BIGINT) AS label, CASE WHEN (pos - 1) / size::DOUBLE < 0.6::DOUBLE THEN 'train' WHEN (pos - 1) / size::DOUBLE < 0.8::DOUBLE THEN 'calibration' ELSE 'test' END AS split FROM o""",
)
def _(spark, sf):
    rows = views.cand(spark, sf).filter("predicted_class >= 0").withColumnRenamed("predicted_class", "label")
    return rounded(learn.group_split(rows, "tic_id", "label"))


@query(
    "dm15_kfold",
    with_views("view64") + f" SELECT vec_id, CAST(label AS BIGINT) AS label, CAST((row_number() OVER (PARTITION BY label ORDER BY {draw_sql('fold', 'vec_id')}, vec_id) - 1) % 5 AS BIGINT) AS fold FROM view64",
)
def _(spark, sf):
    return rounded(learn.kfold(views.view64(spark, sf), 5, key="vec_id").select("vec_id", "label", "fold"))


_D = ("vec_id", "variant")
_AUG = f"""a AS (SELECT vec_id, v, variant, {uniform_sql('shift', *_D)} AS u0, {uniform_sql('depth', *_D)} AS u1, {uniform_sql('centre', *_D)} AS u2, 3.0::DOUBLE + vec_id % 5 AS period, 0.5::DOUBLE AS duration
  FROM view64, range(7) r(variant)),
b AS (SELECT *, CAST(floor(u0 * 11) - 5 AS BIGINT) AS sh, CASE WHEN list_min(v) < -0.01 THEN abs(list_min(v)) ELSE 0.5 END AS vd, greatest(5, CAST(floor(duration / period * 64) AS BIGINT)) AS w FROM a),
c AS (SELECT *, least(greatest(vd * ((50e-6::DOUBLE + u1 * 150e-6::DOUBLE) / 100e-6::DOUBLE), 0.05), 0.25) AS dp, w + floor(u2 * greatest(64 - w * 2, 1)) AS ce FROM b),
e AS (SELECT c.*, view, i, v[i + 1] AS x FROM c, range(64) r(i), (VALUES ('global'), ('local')) q(view))"""


_NOISE = uniform_sql("noise-' || view || '-{}", "vec_id", "i")


@query(
    "dm18_augment_views",
    with_views("view64") + f", {_AUG} SELECT vec_id, variant, view, i AS bin, "
    + sql_r6(
        f"CASE variant WHEN 0 THEN x WHEN 1 THEN x + 0.01::DOUBLE * (sqrt(-2.0::DOUBLE * ln({_NOISE.format('radius')})) * cos(2.0::DOUBLE * pi() * {_NOISE.format('angle')})) "
        "WHEN 2 THEN v[least(greatest(i - sh, 0), 63) + 1] ELSE x - dp * exp(-0.5::DOUBLE * CASE view WHEN 'global' THEN ((i - ce) / (w / 4.0::DOUBLE)) * ((i - ce) / (w / 4.0::DOUBLE)) "
        "ELSE ((i - 32) / greatest(3, w // 4)::DOUBLE) * ((i - 32) / greatest(3, w // 4)::DOUBLE) END) END"
    ) + " AS x FROM e",
)
def _(spark, sf):
    df = views.view64(spark, sf).select(
        "vec_id", F.col("v").alias("global_view"), F.col("v").alias("local_view"), F.lit(0.01).alias("median_flux_err"),
        (F.lit(3.0) + F.col("vec_id") % 5).alias("period"), F.lit(0.5).alias("duration"),
    )
    out = learn.augment_views(df, "vec_id")
    return rounded(fold.explode_views(out, ["vec_id", "variant"], "x"))


@query(
    "dm18_augment_views_scale",
    with_views("view64") + f""", a AS (SELECT vec_id, v, variant, 0.9::DOUBLE + {uniform_sql('stretch', *_D)} * 0.2::DOUBLE AS f, list_median(v) AS m FROM view64, range(3, 7) r(variant))
SELECT vec_id, variant, unnest(range(64)) AS bin, round(unnest(list_transform(v, lambda x: m + (x - m) * f)), 6) + 0.0 AS x FROM a""",
)
def _(spark, sf):
    df = views.view64(spark, sf).select("vec_id", F.col("v").alias("global_view"), F.col("v").alias("local_view"))
    out = learn.augment_views(df, "vec_id", variant_style="scale", noise=0.01).filter("variant >= 3")
    return rounded(fold.explode_view(out, "global_view", ["vec_id", "variant"], "x"))


# ---- classifiers: SQL states what must hold of a trained model --------------------

_TAB = ("f1", "f2", "f3", "f4")


def _tabular(spark, sf):
    return views.view64(spark, sf).select("vec_id", "label", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(_TAB)])


_FACTS = (
    with_views("view64") + ", n AS (SELECT label, count(*) AS n FROM view64 GROUP BY label) "
    "SELECT n.label::BIGINT AS label, n, TRUE AS sums_to_one, TRUE AS pred_is_top, TRUE AS beats_majority FROM n"
)


def _facts(scored):
    """Per label: rows, whether probabilities add up to 1 and ``pred`` is the most likely class, whether a model is no worse than the most frequent class."""
    right = (F.col("pred") == F.col("label")).cast("double")
    counts = scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(right).alias("_ok"),
        F.bool_and(F.abs(F.aggregate("probs", F.lit(0.0), lambda a, x: a + x) - 1.0) < 1e-9).alias("sums_to_one"),
        F.bool_and(F.get("probs", F.col("pred")) == F.array_max("probs")).alias("pred_is_top"),
    )
    whole = counts.agg(F.sum("_ok").alias("_right"), F.max("n").alias("_most"))
    beats = (F.col("_right") >= F.col("_most")).alias("beats_majority")
    return rounded(counts.join(F.broadcast(whole), F.lit(True)).select("label", "n", "sums_to_one", "pred_is_top", beats))


@query("dm16_train_tabular", _FACTS)
def _(spark, sf):
    rows = _tabular(spark, sf)
    model = learn.train_tabular(rows, _TAB, trees=20, depth=5)
    return _facts(learn.predict_tabular(model, rows, _TAB))


@query("sl7_importance_table", f"SELECT {len(_TAB)}::BIGINT AS n, 1.0::DOUBLE AS total, TRUE AS falling FROM (SELECT count(*) FROM embeddings)")
def _(spark, sf):
    rows = _tabular(spark, sf)
    table_ = learn.importance_table(learn.train_tabular(rows, _TAB, trees=20, depth=5), rows, _TAB)
    in_order = F.collect_list("importance")
    return rounded(table_.agg(
        F.count(F.lit(1)).alias("n"), F.sum("importance").alias("total"),
        F.forall(F.transform(in_order, lambda x, i: x <= F.coalesce(F.get(in_order, i - 1), x)), lambda ok: ok).alias("falling")))


@query(
    "ag25_cv_summary",
    with_views("view64") + """, p AS (SELECT label, count(*) AS n FROM view64 GROUP BY label)
SELECT CAST(f AS BIGINT) AS fold, CAST(sum((n - f + 2) // 3) AS BIGINT) AS n, TRUE AS learns, TRUE AS learns_nothing_else, TRUE AS of_the_folds FROM p, range(3) r(f) WHERE n > f GROUP BY f""",
)
def _(spark, sf):
    # the labels are unrelated to the embeddings: only a feature that tells the label can be learnt, unless rows leak between folds
    blind = _tabular(spark, sf)
    told = blind.withColumn(_TAB[0], F.col("label") + F.col(_TAB[0]) / 10)
    folds, dark = (pin(learn.cross_validate(df, 3, _TAB, key="vec_id", trees=20, depth=5)) for df in (told, blind))
    summary = learn.cv_summary(folds).select(F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    nothing = learn.cv_summary(dark).select(F.col("mean").alias("_blind"))
    spread = F.max("f1_macro").over(Window.partitionBy()) - F.min("f1_macro").over(Window.partitionBy())
    facts = folds.withColumn("_spread", spread).join(F.broadcast(summary)).join(F.broadcast(nothing))
    return rounded(facts.select(
        "fold", "n", (F.col("_mean") > 0.9).alias("learns"), (F.col("_blind") < 0.4).alias("learns_nothing_else"),
        ((F.col("_std") <= F.col("_spread") / 2 + 1e-9) & (F.col("_std") * 3 >= F.col("_spread") - 1e-9)).alias("of_the_folds")))


@query(
    "ag25_cv_summary_groups",
    with_views("cand") + ", f AS (SELECT sector AS fold, avg(prob_pc) AS f1_macro FROM cand GROUP BY sector) "
    f"SELECT {sql_r6('avg(f1_macro)')} AS mean, {sql_r6('stddev_pop(f1_macro)')} AS std FROM f",
)
def _(spark, sf):
    folds = views.cand(spark, sf).groupBy(F.col("sector").alias("fold")).agg(F.avg("prob_pc").alias("f1_macro"))
    return rounded(learn.cv_summary(folds))


@query("dm17_train_view_model", _FACTS)
def _(spark, sf):
    rows = views.view64(spark, sf).select("vec_id", "label", F.col("v").alias("global_view"), F.col("v").alias("local_view"))
    model = learn.train_view_model(rows, global_bins=16, local_bins=16, iterations=20)
    return _facts(learn.predict_views(model, rows, 16, 16))


# ---- posteriors --------------------------------------------------------------------

_Q = {"rp": "mcmc_rp_rs", "inc": "mcmc_inclination", "a": "mcmc_a_rs", "t0": "mcmc_t0", "per": "mcmc_period", "depth_ppm": "mcmc_depth_ppm", "duration": "mcmc_duration"}


def _quantile_sql(source):
    parts = []
    for c, name in _Q.items():
        stem = "mcmc_depth" if c == "depth_ppm" else name
        q = {p: f"quantile_cont({c}, {p})" for p in (0.16, 0.5, 0.84)}
        parts += [
            f"{sql_r6(q[0.5])} AS {name}", f"{sql_r6(f'{q[0.5]} - {q[0.16]}')} AS {stem}_err_low", f"{sql_r6(f'{q[0.84]} - {q[0.5]}')} AS {stem}_err_high",
        ]
    return f"SELECT tic_id, {', '.join(parts)} FROM (SELECT *, rp * rp * 1e6::DOUBLE AS depth_ppm, {_T14} AS duration FROM {source}) GROUP BY tic_id"


@query("ag21_posterior_quantiles", with_views("samples") + _quantile_sql("samples"))
def _(spark, sf):
    return rounded(posterior.posterior_quantiles(views.samples(spark, sf)))


_GATE = """ac AS (SELECT s_suppkey AS tic_id, w AS walker, CASE WHEN s_nationkey % 4 = 0 AND w = 2 THEN 0.55::DOUBLE ELSE 0.21::DOUBLE + (s_suppkey % 20) / 100.0::DOUBLE END AS acceptance
  FROM supplier, range(1, 8) r(w)),
th AS (SELECT * FROM samples WHERE step >= 1000 AND (step - 1000) % 2 = 0),
ra AS (SELECT tic_id, bool_and(acceptance > 0.2 AND acceptance < 0.5) AS mixed, min(acceptance) AS lo, max(acceptance) AS hi, avg(acceptance) AS me FROM ac GROUP BY tic_id),
gate AS (SELECT ra.*, coalesce(n, 0) AS n FROM ra LEFT JOIN (SELECT tic_id, count(*) AS n FROM th GROUP BY tic_id) t USING (tic_id)),
gg AS (SELECT tic_id, lo, hi, me, n, mixed AND n >= 270 AS ok, CASE WHEN NOT mixed THEN 'MCMC non-convergent — using Nelder-Mead fit' WHEN n < 270 THEN 'MCMC poorly mixed — using Nelder-Mead fit' END AS flag FROM gate)"""
_GATE_COLS = (
    f"tic_id, {sql_r6('lo')} AS acceptance_min, {sql_r6('hi')} AS acceptance_max, {sql_r6('me')} AS acceptance_mean, n AS n_effective_samples, "
    "ok AS mcmc_converged, CASE WHEN ok THEN 'mcmc' ELSE 'nelder_mead' END AS method, flag"
)


def _acceptance(spark, sf):
    rate = F.lit(0.21) + (F.col("s_suppkey") % 20) / 100.0
    return table(spark, sf, "supplier").withColumn("walker", F.explode(F.sequence(F.lit(1), F.lit(7)))).select(
        F.col("s_suppkey").alias("tic_id"), "walker",
        F.when((F.col("s_nationkey") % 4 == 0) & (F.col("walker") == 2), F.lit(0.55)).otherwise(rate).alias("acceptance"),
    )


@query("ag22_chain_gate", with_views("samples") + f", {_GATE} SELECT {_GATE_COLS} FROM gg")
def _(spark, sf):
    return rounded(posterior.chain_gate(views.samples(spark, sf), _acceptance(spark, sf), 1000, 2, min_samples=270))


_TAU = """long AS (UNPIVOT (SELECT tic_id, walker, rp, inc, a, t0, per, row_number() OVER (PARTITION BY tic_id, walker ORDER BY step, rp, inc, a, t0, per) AS i FROM samples) ON rp, inc, a, t0, per INTO NAME parameter VALUE x),
chain AS (SELECT tic_id, walker, parameter, i, x - avg(x) OVER (PARTITION BY tic_id, walker, parameter) AS d, x FROM long),
moves AS (SELECT tic_id, walker, parameter, sum(d * d) AS v, count(*) AS n FROM chain GROUP BY ALL HAVING sum(d * d) > 1e-20 * count(*) * greatest(1, max(abs(x)) ^ 2)),
own AS (SELECT tic_id, walker, parameter, q.i - p.i AS lag, sum(p.d * q.d) / any_value(v) AS rho
  FROM chain p JOIN chain q USING (tic_id, walker, parameter) JOIN moves USING (tic_id, walker, parameter) WHERE q.i >= p.i GROUP BY ALL),
mean AS (SELECT tic_id, parameter, lag, avg(rho) AS rho FROM own GROUP BY ALL),
grown AS (SELECT tic_id, parameter, lag, 2 * sum(rho) OVER (PARTITION BY tic_id, parameter ORDER BY lag) - 1 AS t FROM mean),
tau AS (SELECT tic_id, parameter, coalesce(arg_min(t, lag) FILTER (WHERE lag >= 5 * t), arg_max(t, lag)) AS tau FROM grown GROUP BY ALL),
steps AS (SELECT tic_id, max(n) AS n_steps FROM (SELECT tic_id, walker, count(*) AS n FROM samples GROUP BY ALL) GROUP BY ALL),
plan AS (SELECT tic_id, greatest(CAST(trunc(2 * max(tau)) AS BIGINT), 0) AS b, greatest(CAST(trunc(0.5 * min(tau)) AS BIGINT), 1) AS thin, any_value(n_steps) AS n_steps
  FROM tau JOIN steps USING (tic_id) GROUP BY tic_id)"""


@query("ag22_autocorrelation_times", with_views("samples") + f", {_TAU} SELECT tic_id, parameter, n_steps, {sql_r6('tau')} AS tau FROM tau JOIN steps USING (tic_id)")
def _(spark, sf):
    return rounded(posterior.autocorrelation_times(views.samples(spark, sf)))


_OWN = _GATE.replace("th AS (SELECT * FROM samples WHERE step >= 1000 AND (step - 1000) % 2 = 0)", f"""{_TAU},
th AS (SELECT s.* FROM samples s JOIN plan USING (tic_id), LATERAL (SELECT CASE WHEN b >= n_steps THEN n_steps // 2 ELSE b END AS burn) x
  WHERE step >= burn AND (step - burn) % thin = 0)""")


@query("ag22_chain_gate_own_burn_in", with_views("samples") + f", {_OWN} SELECT {_GATE_COLS} FROM gg")
def _(spark, sf):
    return rounded(posterior.chain_gate(views.samples(spark, sf), _acceptance(spark, sf), min_samples=270))


@query(
    "dm21_summarise_posterior",
    with_views("samples") + f", {_GATE}, kept AS (SELECT * FROM th WHERE tic_id IN (SELECT tic_id FROM gg WHERE ok)), q AS ({_quantile_sql('kept')}) "
    f"SELECT {_GATE_COLS}, q.* EXCLUDE (tic_id) FROM gg LEFT JOIN q USING (tic_id)",
)
def _(spark, sf):
    return rounded(posterior.summarise_posterior(views.samples(spark, sf), _acceptance(spark, sf), 1000, 2, min_samples=270))
