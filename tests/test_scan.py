"""The prefix scan against plain windows, with stretches that are cut often."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspan.operators import intervals as I
from reelspan.operators import scan
from reelspan.operators import timeline as T


def events(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(200)]), i, rng.choice([None, 0.5, -1.25, 3.0, 7.5]), rng.randrange(-(2**40), 2**40)) for i in range(n)]
    return spark.createDataFrame(rows, "k long, at long, id long, v double, w long").repartition(5)


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("own", [True, False])
def test_every_fold_equals_its_window(spark, own, descending):
    df = events(spark)
    folds = {kind: scan.Fold(kind, F.col("w" if kind == "bit_xor" else "v"), own, descending) for kind in ("count", "sum", "max", "min", "bit_xor", "first", "last")}
    order = [F.col(c).desc() if descending else F.col(c) for c in ("at", "id")]
    w = W.partitionBy("k").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if own else -1)
    plain = {"count": F.count("v"), "sum": F.sum("v"), "max": F.max("v"), "min": F.min("v"), "bit_xor": F.bit_xor("w"), "first": F.first("v", True), "last": F.last("v", True)}
    want = df.withColumns({n: c.over(w) for n, c in plain.items()})
    for size in (3, 50, 10_000):
        got = scan.running(df, ["k"], ["at", "id"], scan.dense("at", size), folds)
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_odd_tables(spark):
    df = events(spark)
    folds = {"n": scan.Fold("count", F.lit(1)), "v": scan.Fold("sum", F.col("v"))}  # a fold may take a column's name
    got = scan.running(df.where("k = 1"), ["k"], ["at", "id"], scan.dense("at", 7), folds)
    assert got.columns == ["k", "at", "id", "w", "n", "v"] and got.agg(F.max("n")).first()[0] == got.count()
    assert scan.running(df.limit(0), ["k"], ["at", "id"], scan.dense("at", 7), folds).count() == 0
    whole = scan.running(df, [], ["id"], scan.dense("id", 7), folds)  # without keys: one sequence
    assert whole.agg(F.max("n")).first()[0] == 600
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (3.0,)], "t double")
    assert [r[0] for r in odd.select(scan.timed("t", 1.0)).collect()] == [10**15, 10**15, -(10**15), None, 3]


def test_operators_give_the_same_with_short_stretches(spark, monkeypatch):
    rng = random.Random(2)
    seg, rng_rows = [], []
    for video in (1, 2):
        at = 0.0
        for i in range(400):
            at += rng.choice([0.5, 40.0, -20.0])
            seg.append((video, i, at, at + 1.5, rng.choice(["", "some words", "x" * 40])))
        rng_rows += [(video, i, float(s := rng.randrange(0, 90_000)), float(s + rng.randrange(-5, 400))) for i in range(150)]
    segments = spark.createDataFrame(seg, "video_id long, seg_no long, start_sec double, end_sec double, text string")
    ranges = spark.createDataFrame(rng_rows, "video_id long, range_no long, start_sec double, end_sec double")
    markers = ranges.select("video_id", F.col("start_sec").alias("marker_sec"), F.col("range_no").alias("marker_id"))
    lengths = ranges.groupBy("video_id").agg(F.max("end_sec").alias("duration_sec"))
    jobs = {
        "windows": lambda: T.window_totals(segments), "budget": lambda: T.within_budget(segments, 4000), "coalesced": lambda: I.coalesced(ranges, 5.0), "compacted": lambda: I.compacted(ranges),
        "remapped": lambda: I.remapped(segments, ranges), "paired": lambda: I.marker_ranges(markers, lengths),
    }
    whole = {n: sorted(map(repr, f().collect())) for n, f in jobs.items()}
    monkeypatch.setattr(scan, "STRETCH_ROWS", 7)
    assert {n: sorted(map(repr, f().collect())) for n, f in jobs.items()} == whole and all(whole.values())


def test_one_key_is_many_tasks_work(spark):
    """The rows of a single video lie in several partitions, and no window of rows has the video alone as its key."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1_000_000).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("seg_no"))
        got = scan.running(df, ["video_id"], ["seg_no"], scan.dense("seg_no", 10_000), {"end": scan.Fold("sum", F.lit(0.5))})
        spread = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum((F.col("end") != (F.col("seg_no") + 1) * 0.5).cast("int")).alias("wrong")).collect()
        assert len(spread) > 1 and max(r["n"] for r in spread) < 600_000 and sum(r["wrong"] for r in spread) == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_channel_timeline(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 2.0, "ab"), (1, 1, 2.0, 3.5, "c"), (65, 0, 0.0, 1.0, "d"), (300, 0, 1.0, 4.0, "e")], "video_id long, seg_no long, start_sec double, end_sec double, text string")
    videos = spark.createDataFrame([(1, "x"), (65, "x"), (300, "y")], "video_id long, channel string")
    got = T.channel_timeline(seg, videos).orderBy("channel", "video_id", "seg_no").collect()
    assert [tuple(r) for r in got] == [("x", 1, 0, 0.0, 2.0, 3), ("x", 1, 1, 2.0, 3.5, 5), ("x", 65, 0, 3.5, 4.5, 7), ("y", 300, 0, 0.0, 3.0, 2)]
