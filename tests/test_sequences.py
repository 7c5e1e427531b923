"""Bucketed sequence helpers against plain Python, on one hot key and many small ones."""

import random

import pytest
from pyspark.sql import functions as F

from fleetwatch.operators.sequences import previous_values, range_bucket, rank_rows
from fleetwatch.operators.stats import grouped_mad, grouped_median, nearest_rank


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out, pos = [], 0
    for _ in range(600):
        pos += rng.choice([0, 1, 1, 2, 300])
        key = "hot" if rng.random() < 0.4 else rng.choice([None, *[f"k{i}" for i in range(30)]])
        out.append((key, pos, len(out), rng.randrange(3)))
    return out


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("width", [1, 7, 1000])
def test_previous_values(spark, rows, n, width):
    df = spark.createDataFrame(rows, "key string, pos long, id long, v long")
    got = previous_values(df, ["key"], range_bucket("pos", width), ["pos", "id"], "v", n).collect()
    seen, want = {}, {}
    for key, _, i, v in rows:
        past = seen.setdefault(key, [])
        want[i] = [past[-j] if len(past) >= j else None for j in range(1, n + 1)]
        past.append(v)
    assert len(got) == len(rows)
    for r in got:
        assert [r[f"prev_{j}"] for j in range(1, n + 1)] == want[r["id"]]


def test_previous_values_without_key(spark, rows):
    df = spark.createDataFrame(rows, "key string, pos long, id long, v long")
    got = previous_values(df, [], range_bucket("pos", 5), ["pos", "id"], "v", 2).orderBy("id").collect()
    for i, r in enumerate(got):
        assert r["prev_1"] == (rows[i - 1][3] if i > 0 else None)
        assert r["prev_2"] == (rows[i - 2][3] if i > 1 else None)


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_rank_rows(spark, rows, keys):
    df = spark.createDataFrame(rows, "key string, pos long, id long, v long")
    got = {r["id"]: r["rank"] for r in rank_rows(df, keys, range_bucket("pos", 9), ["pos", "id"]).collect()}
    count = {}
    for key, _, i, _ in rows:
        k = key if keys else ""
        count[k] = count.get(k, 0) + 1
        assert got[i] == count[k]


def _median(v):
    s = sorted(v)
    return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2


@pytest.mark.parametrize("accuracy", [1, 50, 10_000])
def test_grouped_median_and_mad(spark, accuracy):
    rng = random.Random(3)
    data = {"one": [5.0], "two": [1.0, 2.0], "same": [4.0] * 6,
            "skew": [rng.random() for _ in range(301)] + [1e9], "ints": [float(rng.randrange(9)) for _ in range(200)]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "key string, v double")
    for r in grouped_median(df, ["key"], "v", accuracy).collect():
        assert r["median"] == pytest.approx(_median(data[r["key"]])) and r["n"] == len(data[r["key"]])
    for r in grouped_mad(df, ["key"], "v").collect():
        m = _median(data[r["key"]])
        assert r["mad"] == pytest.approx(_median([abs(x - m) for x in data[r["key"]]]))


def test_nearest_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "v double")
    r = nearest_rank(df, "v", 0.95).first()
    assert (r["n"], r["quantile"], r["max"]) == (100, 95.0, 100.0)
    wide = spark.range(20_001).select((F.col("id") * 7919 % 20_001).cast("double").alias("v"))
    for q in (0.0, 0.5, 0.95, 1.0):
        assert nearest_rank(wide, "v", q).first()["quantile"] == round(q * 20_000)
    empty = nearest_rank(df.where("v < 0"), "v", 0.95).first()
    assert empty["n"] == 0 and empty["quantile"] is None
