"""All registered queries against DuckDB on the small tables."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(n for n in ORACLE if n in entry.REGISTRY))
def test_same_answer_as_sql(spark, small, con, name):
    got = entry.queries()[name](spark, small).toPandas()
    assert differences(got, con.execute(ORACLE[name]).df()) == ""


@pytest.fixture(scope="module")
def hot(tmp_path_factory, small):
    """The small tables with one user holding a third of all events."""
    import shutil
    from pathlib import Path

    import pandas as pd

    folder = tmp_path_factory.mktemp("hot")
    for f in Path(small).glob("*.parquet"):
        if f.stem != "events":
            shutil.copy(f, folder)
    ev = pd.read_parquet(f"{small}/events.parquet")
    extra = ev.sample(len(ev) // 2, random_state=0).assign(user_id=3)
    extra["ts"] = extra.ts + pd.Timedelta(minutes=7)
    pd.concat([ev, extra], ignore_index=True).to_parquet(folder / "events.parquet", coerce_timestamps="us")
    return str(folder)


@pytest.mark.parametrize("name", ["all_features", "window_targets", "gap_runs", "wind_statistics", "leave_one_out_quantiles", "manifest"])
def test_hot_user_and_block_layout_give_the_same_answer(spark, hot, monkeypatch, name):
    from panelcast.operators import layout

    monkeypatch.setattr(layout, "SERIES_ROW_LIMIT", 100)
    assert layout.Layout.detect(spark.read.parquet(f"{hot}/events.parquet"), "ts").blocked
    got = entry.queries()[name](spark, hot).toPandas()
    assert differences(got, duck(hot).execute(ORACLE[name]).df()) == ""


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0


def test_features_need_one_exchange_on_the_series(spark, small):
    plan = entry.queries()["all_features"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(series_id") == 2  # the hourly cells, then the series
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_every_inventory_item_has_a_query():
    want = [f"IO{i}" for i in range(1, 13)] + [f"P{i}" for i in range(1, 17)] + [f"J{i}" for i in range(1, 12)]
    want += [f"F{i}" for i in range(1, 15)] + [f"W{i}" for i in range(1, 5)] + ["N1", "N2"] + [f"A{i}" for i in range(1, 18)]
    want += [f"B{i}" for i in range(1, 10)] + [f"E{i}" for i in range(1, 7)] + [f"U{i}" for i in range(1, 6)] + ["R1", "R2"]
    want += [f"Q{i}" for i in range(1, 5)] + [f"C{i}" for i in range(1, 11)] + [f"L{i}" for i in range(1, 6)]
    have = {c for q in entry.REGISTRY.values() for c in q.covers}
    assert sorted(set(want) - have) == []


def test_every_query_has_sql():
    assert [n for n, q in entry.REGISTRY.items() if q.oracle is None] == []
