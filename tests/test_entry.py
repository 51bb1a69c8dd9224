"""The registered queries and their SQL twins."""

import os
import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    # operators of training data have brute-force tests of their own
    assert not [n for n in set(queries) - set(oracles) if not re.match(r"op\d+_|pipeline$", n)]


def test_every_operator_family_is_registered():
    names = {n.split("_")[0] for n in entry.queries()}
    wanted = (
        [f"pr{i}" for i in range(1, 28)] + [f"jn{i}" for i in range(1, 18)] + [f"ag{i}" for i in range(1, 31)]
        + [f"wn{i}" for i in range(1, 8)] + [f"sl{i}" for i in range(1, 8)] + [f"st{i}" for i in range(1, 7)]
        + [f"dm{i}" for i in range(1, 29)] + [f"io{i}" for i in range(1, 14)]
    )
    assert [w for w in wanted if w not in names] == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["dm3_period_search", "jn4_nearest_ld", "ag19_roc_auc_ovr", "dm10_extract_features"])
def test_against_sql(spark, name):
    import duckdb

    from tools.check import TABLES, rows_of

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())


def test_no_row_at_a_time_udfs(spark):
    for name in ("dm7_phase_fold", "ag1_sigma_clip", "dm12_ensemble_log", "jn6_mark_gap_edges", "ag24_centroid_stats"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
