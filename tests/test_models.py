"""Evaluation, calibration, splits, classifiers and posterior summaries."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from photospark.operators import calibrate, evaluate, learn, posterior


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(4)
    logits = rng.normal(0, 1, (400, 4))
    label = rng.integers(0, 4, 400)
    logits[np.arange(400), label] += 1.0
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    frame = pd.DataFrame({"id": range(400), "label": label, "probs": p.round(2).tolist(), "logits": (logits * 3).tolist()})
    df = spark.createDataFrame(frame).withColumn("pred", (F.array_position("probs", F.array_max("probs")) - 1).cast("int"))
    return frame, df


def test_auc_against_pairs(scored):
    frame, df = scored
    got = {r.label_class: r.auc for r in evaluate.roc_auc_ovr(df).collect()}
    p = np.array(frame.probs.tolist())
    for k in range(4):
        a, b = p[frame.label == k, k], p[frame.label != k, k]
        wins = (a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()
        assert got[k] == pytest.approx(wins / (len(a) * len(b)))
    assert evaluate.macro_auc(evaluate.roc_auc_ovr(df.filter("label < 3"))).first().roc_auc is None


def test_gates_severity(spark):
    rates = spark.createDataFrame([(0.95, 0.9, 0.85, 0.05, 0.03), (0.95, 0.9, 0.5, 0.05, 0.03), (0.95, 0.9, 0.5, 0.05, 0.1)],
                                  "accuracy double, planet_recall double, planet_precision double, fpr double, ece double")
    assert [r.severity for r in evaluate.binary_gates(rates).collect()] == [0, 2, 1]
    empty = spark.createDataFrame([], "label int, pred int")
    assert evaluate.binary_rates(empty).first().accuracy == 0.0


def test_temperature_recovers_scale(scored):
    frame, df = scored
    fitted = calibrate.fit_temperature(df).first()
    z, y = np.array(frame.logits.tolist()), frame.label.to_numpy()

    def loss(t):
        s = z / t
        s = s - s.max(1, keepdims=True)
        return -(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(1))).mean()

    grid = np.linspace(fitted.temperature - 0.2, fitted.temperature + 0.2, 4001)
    best = grid[np.argmin([loss(t) for t in grid])]
    assert fitted.temperature == pytest.approx(best, abs=1e-2) and fitted.loss == pytest.approx(loss(fitted.temperature))


def test_ensemble_weights_and_missing_crowdsap(spark):
    with pytest.raises(ValueError):
        calibrate.ensemble_logits(F.col("a"), F.col("b"), (0.6, 0.6))
    df = spark.createDataFrame([([0.9, 0.05, 0.03, 0.02], [0.8, 0.1, 0.05, 0.05])], "cnn array<double>, xgb array<double>")
    row = calibrate.ensemble(df).first()
    z = 0.6 * np.log(np.array(row.cnn) + 1e-10) + 0.4 * np.log(np.array(row.xgb) + 1e-10)
    assert np.allclose(row.probs, np.exp(z) / np.exp(z).sum()) and row.predicted_class == 0


def test_group_split_and_kfold(spark):
    rows = [(g, g % 4, i) for g in range(200) for i in range(3)]
    df = spark.createDataFrame(rows, "g bigint, label int, i int")
    split = learn.group_split(df, "g", "label").toPandas()
    assert split.g.is_unique and len(split) == 200
    assert split.groupby("label").split.value_counts().unstack().to_dict("records") == [{"calibration": 10, "test": 10, "train": 30}] * 4
    folds = learn.kfold(df.filter("i = 0"), 5, key="g").toPandas()
    assert (folds.groupby(["label", "fold"]).size() == 10).all()


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    got = {r.label: r.weight for r in evaluate.class_weights(df).collect()}
    assert got == {0: pytest.approx(8 / 12), 1: 2.0, 2: 1.0, 3: 1.0}


def test_augmentation_is_repeatable(spark):
    v = [0.0] * 20 + [-1.0] + [0.0] * 20
    df = spark.createDataFrame([(i, v, v, 0.01, 3.0, 0.1) for i in range(5)],
                               "id bigint, global_view array<double>, local_view array<double>, median_flux_err double, period double, duration double")
    a, b = learn.augment_views(df, "id").toPandas(), learn.augment_views(df, "id").toPandas()
    a, b = (x.sort_values(["id", "variant"]).reset_index(drop=True) for x in (a, b))
    assert len(a) == 35 and all(np.array_equal(x, y) for x, y in zip(a.global_view, b.global_view))
    assert all(list(x) == v for x in a[a.variant == 0].global_view)
    assert all(0 < np.std(np.array(x) - v) < 0.05 for x in a[a.variant == 1].global_view)
    for x in a[a.variant >= 3].local_view:
        assert 0.05 <= (np.array(v) - np.array(x)).max() <= 0.25 + 1e-12


def test_tabular_and_view_models_beat_majority(spark):
    rng = np.random.default_rng(0)
    label = np.repeat(range(4), 60)
    x = rng.normal(0, 0.3, (240, 2)) + np.stack([label % 2, label // 2], 1) * 2.0
    frame = pd.DataFrame({"tic_id": range(240), "label": label, "a": x[:, 0], "b": x[:, 1]})
    df = spark.createDataFrame(frame)
    model = learn.train_tabular(df, ("a", "b"), trees=10, depth=4)
    assert evaluate.binary_rates(learn.predict_tabular(model, df, ("a", "b"))).first().accuracy > 0.9
    assert sum(r.importance for r in learn.importance_table(model, df, ("a", "b")).collect()) == pytest.approx(1.0)
    summary = learn.cv_summary(learn.cross_validate(df, 3, ("a", "b"), trees=5, depth=3)).first()
    assert summary["mean"] > 0.8 and summary["std"] >= 0
    views = df.select("tic_id", "label", F.array(*[F.col("a")] * 8).alias("global_view"), F.array(*[F.col("b")] * 8).alias("local_view"))
    vm = learn.train_view_model(views, global_bins=4, local_bins=4)
    out = learn.predict_views(vm, views, 4, 4)
    assert evaluate.binary_rates(out).first().accuracy > 0.8
    assert out.select(F.aggregate("probs", F.lit(0.0), lambda a, b: a + b).alias("s")).first().s == pytest.approx(1.0)


def test_posterior_summary(spark):
    rng = np.random.default_rng(1)
    n = 500
    frame = pd.DataFrame({
        "tic_id": 1, "walker": np.arange(n) % 5, "step": np.arange(n), "rp": rng.normal(0.1, 0.01, n), "inc": rng.normal(88, 0.01, n),
        "a": rng.normal(10, 0.01, n), "t0": rng.normal(0, 0.01, n), "per": rng.normal(2, 0.01, n),
    })
    samples = spark.createDataFrame(frame)
    row = posterior.posterior_quantiles(samples).first()
    low, mid, high = np.percentile(frame.rp, [16, 50, 84])
    assert (row.mcmc_rp_rs, row.mcmc_rp_rs_err_low, row.mcmc_rp_rs_err_high) == pytest.approx((mid, mid - low, high - mid))
    assert row.mcmc_depth_ppm == pytest.approx(np.percentile(frame.rp**2 * 1e6, 50))
    good = spark.createDataFrame([(1, w, 0.3) for w in range(5)], "tic_id bigint, walker int, acceptance double")
    assert posterior.chain_gate(samples, good, 100, 2).first().n_effective_samples == 200
    assert posterior.summarise_posterior(samples, good, 100, 2).first().mcmc_rp_rs is not None
    bad = posterior.summarise_posterior(samples, good.withColumn("acceptance", F.lit(0.5)), 100, 2).first()
    assert not bad.mcmc_converged and bad.method == "nelder_mead" and bad.mcmc_rp_rs is None
    few = posterior.chain_gate(samples, good, 450, 1).first()
    assert few.flag.startswith("MCMC poorly mixed")
    assert posterior.burn_in(50, 20, 5000) == (100, 10) and posterior.burn_in(3000, 1, 5000) == (2500, 1)


def test_autocorrelation_time_of_a_known_process(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(6)
    share, n = 0.8, 3000  # a first-order process has time (1 + share) / (1 - share) = 9
    frames = []
    for walker in range(8):
        x = np.zeros(n)
        for i, e in enumerate(rng.normal(size=n)[1:], 1):
            x[i] = share * x[i - 1] + e
        frames.append(pd.DataFrame({"tic_id": 1, "walker": walker, "step": np.arange(n), "rp": x, "inc": rng.normal(size=n), "a": 3.0, "t0": x, "per": x}))
    chains = spark.createDataFrame(pd.concat(frames).sample(frac=1.0, random_state=1))
    got = {r.parameter: r.tau for r in posterior.autocorrelation_times(chains).collect()}
    assert got["rp"] == pytest.approx(9.0, rel=0.15) and got["inc"] == pytest.approx(1.0, abs=0.15) and got["a"] is None
    plan = posterior.chain_plan(chains).first()
    assert (plan.burn, plan.thin) == posterior.burn_in(max(got["rp"], got["inc"]), min(got["rp"], got["inc"]), n)
    still = posterior.chain_plan(chains.withColumns({c: F.lit(1.0) for c in posterior.PARAMETERS})).first()
    assert (still.burn, still.thin) == (1000, 10)
    walk = [rng.normal(size=m).cumsum() for m in (40, 25, 40)]
    direct = []
    for lag in range(40):
        own = [np.dot(w[: len(w) - lag] - w.mean(), w[lag:] - w.mean()) / np.dot(w - w.mean(), w - w.mean()) for w in walk if len(w) > lag]
        direct.append(np.mean(own))
    assert np.allclose(posterior.autocorrelation(walk), direct)
    assert posterior.integrated_time(np.zeros(0)) is None
