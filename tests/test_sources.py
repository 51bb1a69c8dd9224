"""Files: archives, CSV, JSON, parquet, published products."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import cand_df, series_df, transit_curve
from photospark import schema
from photospark.operators import contracts, publish
from photospark.sources import publish as sink
from photospark.sources import series, tables


def test_archive_round_trip(spark, tmp_path):
    time = np.array([1.0, 2.0, np.nan])
    np.savez_compressed(
        tmp_path / "tic0000000000000042_s0003_raw.npz", time=time, flux=np.array([1.0, 2.0, 3.0]), flux_err=np.full(3, 0.1),
        quality=np.array([0, 4, 0], dtype=np.int32), meta_json=json.dumps({"tmag": 9.5, "ra": float("nan"), "download_status": "SUCCESS"}),
    )
    np.savez_compressed(
        tmp_path / "tic0000000000000043_s0001_preprocessed.npz", time=time[:2], flux=np.ones(2), flux_err=np.ones(2), gap_mask=np.array([True, False])
    )
    (tmp_path / "tic0000000000000044_s0003_raw.npz").write_bytes(b"broken")
    (tmp_path / "other.npz").write_bytes(b"")
    keys = {(r.tic_id, r.sector, r.kind) for r in series.series_keys(spark, str(tmp_path), [1, 3]).collect()}
    assert keys == {(42, 3, "raw"), (43, 1, "preprocessed"), (44, 3, "raw")}
    rows = series.read_series_archive(spark, str(tmp_path)).orderBy("tic_id", F.col("time_us").asc_nulls_last()).collect()
    assert len(rows) == 5 and rows[0].time_us == schema.DAY_US and rows[1].quality == 4 and rows[2].time_us is None
    assert [r.gap_mask for r in rows[3:]] == [True, False] and rows[3].quality is None
    assert series.read_series_archive(spark, str(tmp_path), sectors=[3], kind="raw").count() == 3
    errors = series.read_series_archive(spark, str(tmp_path), errors=True).collect()
    assert [e.tic_id for e in errors] == [44] and errors[0].error
    meta = {r.tic_id: r for r in series.read_series_meta(spark, str(tmp_path)).collect()}
    assert meta[42].tmag == 9.5 and meta[42].ra is None and meta[42].download_status == "SUCCESS" and meta[44].meta_json is None


def test_archive_files_are_chosen_by_name(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

    from photospark.sources import archive

    curve = transit_curve(n=40)
    content = {}
    for tic in (1, 2, 30):
        with open(tmp_path / "x", "wb") as out:
            np.savez_compressed(out, time=curve.time + tic, flux=curve.flux, flux_err=curve.flux_err)
        content[tic] = (tmp_path / "x").read_bytes()
    rows = [(t, s, "raw", content[t]) for t in content for s in (1, 2)] + [(5, 3, "raw", b"cut off")]
    path = str(tmp_path / "arch")
    names = archive.write_archives(spark.createDataFrame(rows, "tic_id bigint, sector int, kind string, content binary").repartition(3), path)
    assert names.count() == 7 and {p.name for p in (tmp_path / "arch").iterdir() if not p.name.startswith(".")} == {r.name for r in names.collect()}
    read = archive.read_archives(spark, path)
    assert read.count() == 241 and [r.tic_id for r in read.filter("error is not null").collect()] == [5]
    reader = archive.Reader(path)
    left = list(reader.pushFilters([In(("sector",), (1, 3)), GreaterThan(("tic_id",), 1), EqualTo(("flux",), 1.0), StringContains(("kind",), "r")]))
    assert [type(f).__name__ for f in left] == ["EqualTo", "StringContains"]
    assert [f[1:3] for p in reader.partitions() for f in p.files] == [(2, 1), (5, 3), (30, 1)]
    # the filters leave one file, which goes before the rows are read: nothing else is opened instead
    (tmp_path / "arch" / "tic0000000000000030_s0002_raw.npz").write_bytes(b"broken too")
    assert series.read_series_archive(spark, path, sectors=[2]).filter("tic_id < 30").count() == 80
    assert series.read_series_archive(spark, path, errors=True).filter("tic_id < 30").count() == 1
    assert series.read_series_archive(spark, path, sectors=[1], errors=True).count() == 0
    plan = series.read_series_archive(spark, path, sectors=[2])._jdf.queryExecution().executedPlan().toString()
    assert "sector" not in plan.partition("Filter")[2].split("BatchScan")[0]


def test_series_parquet_prunes_sectors(spark, tmp_path):
    path = str(tmp_path / "lc")
    df = series_df(spark, transit_curve(n=50, sector=1), transit_curve(n=60, sector=2)).withColumn("flux_norm", F.col("flux"))
    series.write_series(df, path)
    one = series.read_series(spark, path, [2])
    assert one.count() == 60 and "flux_norm" in one.columns
    assert "PartitionFilters: [isnotnull(sector" in one._jdf.queryExecution().executedPlan().toString()


def test_csv_sources(spark, tmp_path):
    (tmp_path / "tce.csv").write_text(
        "# comment\nkepid,tce_plnt_num,tce_period,tce_time0bk,tce_duration,tce_depth,av_training_set\n1,1,2.5,100.0,12.0,50.0,PC\n2,1,x,1,6,1,\n"
    )
    rows = tables.read_tce_csv(spark, str(tmp_path / "tce.csv")).orderBy("kepid").collect()
    assert rows[0].duration == 0.5 and rows[0].label_class == "PC" and rows[1].tce_period is None
    (tmp_path / "toi.csv").write_text("# c\nTIC ID,TFOPWG Disposition,x\n10,PC,1\nbad,EB,2\n11,FP,3\n")
    got = tables.read_dispositions_csv(spark, str(tmp_path / "toi.csv")).orderBy("row_no").collect()
    assert [(r.tic_id, r.disposition) for r in got] == [(10, "PC"), (11, "FP")]
    (tmp_path / "toi2.csv").write_text("TIC,TOI\n10,101.01\n")
    assert tables.read_dispositions_csv(spark, str(tmp_path / "toi2.csv")).first().disposition == "PC"
    (tmp_path / "no.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        tables.read_dispositions_csv(spark, str(tmp_path / "no.csv"))


def test_json_results_and_log(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "1.json").write_text(json.dumps({"tic_id": 1, "fpp": 0.01, "nfpp": 1e-4}, indent=2))
    (tmp_path / "r" / "2.json").write_text(json.dumps({"tic_id": 2, "status": "FAILED"}, indent=2))
    got = {r.tic_id: (r.fpp, r.status) for r in tables.read_results_json(spark, str(tmp_path / "r"), schema.TRICERATOPS_SCHEMA).collect()}
    assert got == {1: (0.01, None), 2: (None, "FAILED")}
    log = str(tmp_path / "log")
    tables.append_run_log(spark.createDataFrame([("a", 1)], "step string, n int"), log)
    tables.append_run_log(spark.createDataFrame([("b", 2.5)], "step string, runtime double"), log)
    assert {r.step for r in tables.read_run_log(spark, log).collect()} == {"a", "b"}


def test_catalogue_parquet(spark, tmp_path):
    path = str(tmp_path / "cat")
    tables.write_catalogue(cand_df(spark, [(1, 1, 1, 3.0, 1.5, 0.15, 0.01, 9.0, 9.0)]), path)
    df = tables.read_catalogue(spark, path, ["tic_id", "sde"]).filter("sde > 5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(sde), GreaterThan(sde,5.0)]" in plan and "ReadSchema: struct<tic_id:bigint,sde:double>" in plan


CANDS = [(1, 1, 1, 3.0, 1.5, 0.15, 0.01, 6.0, 9.0), (2, 1, 1, 2.0, 1.5, 0.1, 0.02, 9.0, 9.0), (3, 1, 1, 2.0, 1.5, 0.1, 0.0, 4.0, 9.0)]


def test_published_files(spark, tmp_path):
    cat = cand_df(spark, CANDS).withColumns({"prob_pc": F.lit(0.95), "predicted_class": F.lit(0), "rp_rs": F.lit(0.1)})
    sink.export_catalogue_csv(cat, str(tmp_path / "csv"), files=1)
    text = next((tmp_path / "csv").glob("part-*.csv")).read_text().splitlines()
    assert text[0] == ",".join(publish.REPORT_COLUMNS) and [line.split(",")[0] for line in text[1:]] == ["2", "1", "3"]
    assert text[1].split(",")[1] == "2.000000" and "SUB-THRESHOLD" in text[3] and text[1].split(",")[10] == ""
    sink.export_candidates_json(cat, str(tmp_path / "json"))
    rows = [json.loads(x) for f in (tmp_path / "json").glob("part-*") for x in f.read_text().splitlines()]
    assert len(rows) == 3 and {type(r["tic_id"]) for r in rows} == {str} and [r["depth"] for r in rows if r["tic_id"] == "3"] == [None]
    tri = spark.createDataFrame([(2, 0.01, 1e-4)], "tic_id bigint, fpp double, nfpp double")
    sink.export_star_json(cat, str(tmp_path / "stars"), tri, spark.createDataFrame([(2,)], "tic_id bigint"))
    files = list((tmp_path / "stars").glob("star=*/part-*"))
    assert [f.parent.name for f in files] == ["star=2"]
    doc = json.loads(files[0].read_text())
    assert doc["triceratops"]["fpp"] == 0.01 and doc["mcmc_available"] and doc["plots"]["corner"] == "/plots/2/corner.png"


def test_payload_round_trip_and_contract(spark, tmp_path):
    cat = cand_df(spark, CANDS).withColumns({"prob_pc": F.lit(0.95), "predicted_class": F.lit(0), "ra": F.lit(10.0), "dec": F.lit(-5.0)})
    views = cat.select("tic_id", "sector", "planet_num", F.array(F.lit(0.0), F.lit(-1.0)).alias("global_view"), F.array(F.lit(-1.0)).alias("local_view"))
    tri = cat.select("tic_id", F.lit(0.01).alias("fpp"), F.lit(0.001).alias("nfpp"), F.lit(0.9).alias("tp"), F.lit(0.05).alias("eb"), F.lit(0.03).alias("heb"), F.lit(0.02).alias("bgob"))
    docs = publish.build_payload(publish.payload_entries(cat, views, tri, publish.sector_matrix(cat), 2, 1), 2, "2026-01-01T00:00:00Z")
    sink.export_payload(docs, str(tmp_path / "p"))
    back = sink.read_payload(spark, str(tmp_path / "p"), docs.schema)
    assert contracts.validate_payload(back).count() == 0
    assert sum(len(r.candidates) for r in back.collect()) == 3
    broken = back.withColumn("timestamp", F.lit("yesterday"))
    assert {(r.path, r.rule) for r in contracts.validate_payload(broken).collect()} == {("timestamp", "iso8601")}
    entry = back.collect()[0].candidates
    assert next(iter(entry.values())).signal.depth in (10.0, 20.0, 0.0)


def test_diagnostic_tables(spark):
    df = series_df(spark, transit_curve(n=600))
    cat = cand_df(spark, CANDS[:1]).withColumns({f"prob_{c}": F.lit(0.25) for c in ("pc", "eb", "blend", "sv")})
    views = cat.select("tic_id", "sector", "planet_num", F.array(*[F.lit(1.0)] * 5).alias("global_view"))
    fits = cat.select("tic_id", "sector", "planet_num", "period", "duration", "depth", F.lit(0.0).alias("t0_shift"), F.lit(0.5).alias("ingress"))
    power = spark.createDataFrame([(1, 1, 10, 0.5), (2, 1, 10, 0.5)], "tic_id bigint, sector int, period_us bigint, power double")
    out = publish.diagnostic_tables(cat, df, views, power, fits, 5)
    counts = {k: v.count() for k, v in out.items()}
    assert counts == {"light_curve": 600, "epochs": 10, "periodogram": 1, "folded": 5, "classes": 4}


def test_many_small_archives_are_one_batch():
    """Archives of a few cadences share batches; a broken one is a row among them."""
    import io

    import numpy as np

    from photospark.sources import archive

    files = []
    for i in range(500):
        time = np.array([i, i + 0.5, np.nan])
        columns = {"time": time, "flux": time + 1, "flux_err": time * 0, "quality": np.arange(3, dtype=np.int32)}
        content = archive.encode(**columns, meta_json=np.array("{}"))
        with np.load(io.BytesIO(content), allow_pickle=False) as data:
            assert all(np.array_equal(data[n], c, equal_nan=True) for n, c in columns.items()) and str(data["meta_json"]) == "{}"
        files.append((i, 1, "raw", lambda content=content[:60] if i % 5 == 0 else content: content))
    got = list(archive.batches(iter(files)))
    assert len(got) == 1 and got[0].num_rows == 400 * 3 + 100
    rows = got[0].to_pandas()
    assert (rows["error"].notna() == (rows["tic_id"] % 5 == 0)).all()
    one = rows[rows["tic_id"] == 7]
    assert one["time"].tolist()[:2] == [7.0, 7.5] and one["time_us"].isna().tolist() == [False, False, True] and one["quality"].tolist() == [0, 1, 2]


def test_whole_groups_over_batches():
    import pyarrow as pa

    from photospark.plans.groups import whole_groups

    keys = [None, None, 1, 1, 1, 1, 2, 3, 3, None]
    rows = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(range(10))], ["k", "i"])
    for step in (1, 2, 3, 10):
        batches = iter([rows.slice(at, step) for at in range(0, 10, step)])
        found = [t.slice(a, b - a).column("i").to_pylist() for t, ends in whole_groups(batches, ["k"]) for a, b in zip(ends[:-1], ends[1:])]
        assert found == [[0, 1], [2, 3, 4, 5], [6], [7, 8], [9]]


def test_results_are_a_document_per_row(spark, tmp_path):
    """Repeated keys and missing fields keep their rows, and no part of a file is left."""
    import os

    from photospark.schema import TRICERATOPS_SCHEMA

    path = str(tmp_path / "results")
    rows = [(1, 0.5, "a"), (1, 0.5, "a"), (None, None, "b"), (2, None, None)]
    tables.write_results_json(spark.createDataFrame(rows, "tic_id bigint, fpp double, status string").repartition(2), path)
    assert len(os.listdir(path)) == 4 and all(n.endswith(".json") and n[0] != "." for n in os.listdir(path))
    read = tables.read_results_json(spark, path, TRICERATOPS_SCHEMA).select("tic_id", "fpp", "status").collect()
    assert sorted(map(tuple, read), key=str) == sorted(rows, key=str)
