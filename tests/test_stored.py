"""Stacks, manifests, commits, caches and settings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from veldt.sources import settings, stacks


@pytest.fixture
def stack(spark, tmp_path):
    rows = [(m, y, c, float(y + c)) for m in ("a", "b") for y in range(2001, 2006) for c in range(20) if (m, y) != ("b", 2003)]
    root = f"file://{tmp_path}/stack"
    stacks.write_stack(spark.createDataFrame(rows, "metric string, year int, cell long, v double"), root)
    return root


def test_scan_prunes(spark, stack):
    df = stacks.scan_stack(spark, stack, "a", 2002, 2004)
    assert df.columns == ["cell", "year", "v"] and df.count() == 60 and df.agg(F.sum("v")).first()[0] == sum(y + c for y in (2002, 2003, 2004) for c in range(20))
    plan = df._jdf.queryExecution().executedPlan().toString()
    pruned = next(x for x in plan.split("\n") if "PartitionFilters" in x)
    assert "metric" in pruned and "year" in pruned and "PushedFilters: []" in pruned and "Filter (" not in plan
    assert len(df.inputFiles()) >= 3 and df.select("year").distinct().count() == 3
    assert stacks.stack_years(spark, stack) == {"a": [2001, 2002, 2003, 2004, 2005], "b": [2001, 2002, 2004, 2005]}
    for bad in (("b", 2002, 2004), ("a", 2004, 2006), ("c", 2001, 2001)):
        with pytest.raises(ValueError):
            stacks.scan_stack(spark, stack, *bad)


def test_manifest(spark, stack, tmp_path):
    m = spark.createDataFrame(stacks.manifest_of(spark, stack).collect())
    assert stacks.manifest_faults(m, stacks.manifest_of(spark, stack)).count() == 0
    assert stacks.scan_manifest(spark, stack, m, ["a", "b"], [2001, 2005]).groupBy("metric", "year").count().filter("count = 20").count() == 4
    with pytest.raises(ValueError):
        stacks.scan_manifest(spark, stack, m, ["b"], [2003])
    files = sorted((tmp_path / "stack").rglob("*.parquet"))
    files[0].unlink()
    (files[1].parent / "more.parquet").write_bytes(files[2].read_bytes())
    files[3].write_bytes(files[4].read_bytes())
    for crc in (tmp_path / "stack").rglob(".*.crc"):
        crc.unlink()
    got = {r.path.rsplit("/", 1)[1]: r.fault for r in stacks.manifest_faults(m, stacks.manifest_of(spark, stack)).collect()}
    assert got == {files[0].name: "missing", "more.parquet": "unknown", files[3].name: "changed"}


def test_commit_is_all_or_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/tables"
    assert stacks.committed(spark, root) == {}
    one, two = spark.range(5), spark.range(7)
    stacks.commit_all(spark, root, {"x": one, "y": one})
    bad = spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("a task fails"))).otherwise(F.lit(1)).alias("id"))
    with pytest.raises(Exception, match="a task fails"):
        stacks.commit_all(spark, root, {"x": two, "y": bad})
    now = stacks.committed(spark, root)
    assert {k: v.count() for k, v in now.items()} == {"x": 5, "y": 5}
    assert len([p for p in (tmp_path / "tables").iterdir() if p.name.startswith("v-")]) == 1
    stacks.commit_all(spark, root, {"x": two})
    assert {k: v.count() for k, v in stacks.committed(spark, root).items()} == {"x": 7} and now["y"].count() == 5
    assert stacks.vacuum(spark, root) == 1 and stacks.committed(spark, root)["x"].count() == 7


def test_cache_and_json(spark, tmp_path):
    root, made = f"file://{tmp_path}/cache", []

    def make():
        made.append(1)
        return spark.range(3)

    assert [stacks.cached(spark, root, c, make).count() for c in ({"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": 1, "b": 3})] == [3, 3, 3] and len(made) == 2
    assert stacks.config_id({"a": "é"}) != stacks.config_id({"a": "e"})
    path = f"file://{tmp_path}/run.json"
    assert stacks.read_json(spark, path) is None
    for value in ({"b": [1, None], "a": "森"}, {"c": 1}):
        stacks.write_json(spark, path, value)
        assert stacks.read_json(spark, path) == value
    assert [p.name for p in tmp_path.glob("run*")] == ["run.json"]


def test_numbers():
    good = {"3": [3], "-2.5": [-2.5], "c(50, 75, 100)": [50, 75, 100], "2001:2004": [2001, 2002, 2003, 2004], "c(1:3, 10 - 2, -(4))": [1, 2, 3, 8, -4], "3:1": [3, 2, 1], "c()": [], "+1": [1], "-1:1": [-1, 0, 1]}
    for text, want in good.items():
        assert settings.numbers(text) == want
    for bad in ("", "x", "c", "c(x)", "2*3", "2**9", "1:", "a:b", "__import__('os')", "c(1)(2)", "[1]", "'1'", "True", "span(1, 2)", "c(1, 2) + 1", "lambda: 1", "1 if 1 else 2", "c(n=1)", "1:2:3", "1.5:2"):
        with pytest.raises(ValueError):
            settings.numbers(bad)


def test_settings():
    env = {"B": "2000", "F": "0.5", "ON": "Yes", "L": "c(50, 75)", "BLANK": " ", "BAD": "1e3", "INF": "inf", "Q": "maybe", "M": "by"}
    assert settings.setting(env, "B", int, 1, low=1) == 2000 and settings.setting(env, "F", float, 0.1, 0, 1) == 0.5
    assert settings.setting(env, "ON", bool, False) is True and settings.setting(env, "L", list, []) == [50, 75]
    assert settings.setting(env, "BLANK", int, 7) == 7 and settings.setting(env, "NONE", str, "bh") == "bh" and settings.setting(env, "M", str, "bh", among={"bh", "by"}) == "by"
    for name, kind, more in (("BAD", int, {}), ("INF", float, {}), ("Q", bool, {}), ("B", int, {"high": 9}), ("L", list, {"low": 60}), ("M", str, {"among": {"bh"}})):
        with pytest.raises(ValueError, match=name):
            settings.setting(env, name, kind, None, **more)
