"""Keep-latest and upserts over bucketed tables need no shuffle."""

import random

import pytest

from tableflow import copy_columns, latest_per_key, open_bucketed, upsert, write_bucketed

SCHEMA = "id bigint, day string, t int, v double"
KEYS = ["id", "day"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(1)
    made = {}
    for name, n in (("target_rows", 300), ("source_rows", 80)):
        data = [(rng.randrange(200) if i % 20 else None, "ab"[i % 2], i, float(i)) for i in range(n)]
        plain = spark.createDataFrame(data, SCHEMA).dropDuplicates(KEYS)
        plain.write.parquet(f"{tmp_path}/plain_{name}")
        plain = spark.read.parquet(f"{tmp_path}/plain_{name}")
        made[name] = (plain, write_bucketed(plain, name, f"{tmp_path}/{name}", KEYS, 4, ["t"]))
    yield made
    for name in made:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def merged(target, source):
    return upsert(target, source, on=KEYS, set={"v": "v"}, insert=copy_columns(["id", "day", "t", "v"]), hot=None, broadcast_bytes=0)


def test_upsert_without_a_shuffle(tables):
    (target, bucketed_target), (source, bucketed_source) = tables["target_rows"], tables["source_rows"]
    out = merged(bucketed_target, bucketed_source)
    assert "Exchange" not in plan_of(out) and "Exchange" in plan_of(merged(target, source))
    assert rows(out) == rows(merged(target, source))


def test_keep_latest_without_a_shuffle(tables):
    plain, bucketed = tables["target_rows"]
    out = latest_per_key(bucketed, KEYS, "t", ["v"])
    assert "Exchange" not in plan_of(out) and rows(out) == rows(latest_per_key(plain, KEYS, "t", ["v"]))


def test_files_are_opened_under_another_name(spark, tables, tmp_path):
    plain, bucketed = tables["target_rows"]
    again = open_bucketed(spark, "opened_again", f"{tmp_path}/target_rows", SCHEMA, KEYS, 4, ["t"])
    try:
        assert rows(again) == rows(plain)
        assert "Exchange" not in plan_of(latest_per_key(again, KEYS, "t", ["v"]))
    finally:
        spark.sql("DROP TABLE opened_again")


def test_refused_arguments(spark, tables, tmp_path):
    plain, bucketed = tables["target_rows"]
    for by, n in (([], 4), (KEYS, 0), (["nothing"], 4)):
        with pytest.raises(ValueError):
            write_bucketed(plain, "refused", f"{tmp_path}/refused", by, n)
    with pytest.raises(ValueError):
        write_bucketed(bucketed, "refused", f"{tmp_path}/target_rows", KEYS, 4)
