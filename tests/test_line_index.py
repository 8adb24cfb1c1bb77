"""Pages through the line index against pages over the whole log, and what they read."""

import random

import pytest

from tracelake.operators.events import event_page
from tracelake.sources import line_index as X

ROWS = "file string, ord long, ts_ms long, text string"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    rng = random.Random(3)
    rows = []
    for f in range(6):
        at = 0
        for k in range(rng.choice([1, 5, 60, 300])):
            rows += [(f"f{f}", at, 1000 * k, f"line {f} {k} {i}") for i in range(rng.randint(1, 3))]
            at += rng.randint(1, 90)
    df = spark.createDataFrame(rows, ROWS)
    path = str(tmp_path_factory.mktemp("index"))
    X.write_log(df, path, block=200, parts=11)
    return df, path


@pytest.mark.parametrize("args", [{"tail": 1}, {"tail": 7}, {"tail": 10_000}, {"tail": 5, "before": 400}, {"tail": 3, "before": 1}, {"tail": 4, "before": 201}, {"after": 350}, {"after": 350, "limit": 4}, {"after": 10**9}])
def test_pages_equal_whole_scan(spark, log, args):
    df, path = log
    want = event_page(df, ["file"], **args)
    got = X.page(spark, path, **args).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_only_chosen_blocks_are_read(spark, log):
    df, path = log
    index = X.read_index(spark, path)
    chosen = X.blocks_of(index, tail=3)
    assert chosen.count() < index.count() / 3
    events = X.read_blocks(spark, path, chosen)
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    rows = events.collect()
    lows = {(r.file, r.block) for r in chosen.collect()}
    assert {(r.file, r.ord // 200) for r in rows} == lows
    # and no part without a chosen block is opened
    seen = spark.read.parquet(f"{path}/log").join(chosen.select("part", "file", "block"), ["part", "file", "block"], "left_semi")
    assert seen.select("part").distinct().count() == chosen.select("part").distinct().count() < index.select("part").distinct().count()


def test_time_pruning_and_empty_log(spark, log, tmp_path):
    _, path = log
    index = X.read_index(spark, path)
    assert X.blocks_of(index, tail=10**6, since_ms=250_000).where("max_ts < 250000").count() == 0
    X.write_log(spark.createDataFrame([], ROWS), str(tmp_path / "none"))
    assert spark.read.schema("part int").parquet(str(tmp_path / "none" / "index")).count() == 0
