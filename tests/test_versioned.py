"""The keyed table on disk: versions, touched buckets, failures and conflicts."""

import pytest
from pyspark.sql import functions as F

from reelspan.sources import store
from reelspan.sources.scratch import fresh_folder
from reelspan.sources.versioned import Conflict, KeyedTable


def rows(df):
    return sorted(map(tuple, df.select("key", "value").collect()))


@pytest.fixture
def table(spark):
    made = KeyedTable(spark, fresh_folder(spark, "keyed"))
    made.create(spark.range(200).select(F.concat(F.when(F.col("id") % 2 == 0, "a.").otherwise("b."), F.col("id")).alias("key"), F.col("id").cast("string").alias("value")), buckets=16)
    return made


def changes(spark, found):
    return spark.createDataFrame(found, "key string, value string, change_no long")


def test_changes_equal_those_of_the_whole_store(spark, table):
    begun, new = table.read(), changes(spark, [("a.0", "old", 1), ("a.0", "new", 2), ("c.1", "x", 1), (None, "lost", 1), ("a.2", None, 5)])
    assert rows(begun) == rows(begun.distinct()) and begun.count() == 200
    want = rows(store.upserted(begun, new.where("key is not null")))
    assert table.upsert(new) == 2 and rows(table.read()) == want
    doomed = spark.createDataFrame([("b.1",), ("b.1",), ("none",)], "key string")
    want = rows(store.removed(table.read(), doomed))
    assert table.remove(doomed) == 3 and rows(table.read()) == want
    want = rows(store.purged(table.read(), ["a."]))
    assert table.purge(["a."]) == 4 and rows(table.read()) == want and len(want) == 100
    assert rows(table.read(1)) == rows(begun) and table.versions() == [1, 2, 3, 4]
    assert rows(table.values(spark.createDataFrame([("b.3",), ("a.0",)], "key string"))) == [("b.3", "3")]


def test_buckets_that_no_key_touches_keep_their_files(spark, table):
    before = table.manifest()["folders"]
    table.upsert(changes(spark, [("a.0", "new", 1), ("a.4", "new", 1)]))
    after = table.manifest()["folders"]
    moved = {b for b in before if before[b] != after[b]}
    assert 1 <= len(moved) <= 2 and set(before) == set(after) == {str(b) for b in range(16)}
    read = table.values(spark.createDataFrame([("a.0",)], "key string"))
    assert len(read.inputFiles()) == 1


def test_no_change_makes_no_version(spark, table):
    assert table.upsert(changes(spark, [])) == table.remove(spark.createDataFrame([("none",)], "key string")) == table.purge(["zzz", ""]) == 1


def test_a_failed_change_leaves_the_old_version(spark, table):
    before = rows(table.read())
    broken = spark.range(50).select(F.concat(F.lit("a."), F.col("id")).alias("key"), F.when(F.col("id") == 49, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("value"), F.lit(1).alias("change_no"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(broken)
    assert table.versions() == [1] and rows(table.read()) == before
    assert table.upsert(changes(spark, [("a.0", "new", 1)])) == 2
    assert table.vacuum(1) and rows(table.read()) == rows(store.upserted(spark.createDataFrame(before, "key string, value string"), changes(spark, [("a.0", "new", 1)])))
    assert table.versions() == [2] and table.vacuum(1) == []
    with pytest.raises(FileNotFoundError):
        table.read(1)


def test_the_second_of_two_changes_from_one_version_is_refused(spark, table):
    stale = table.manifest()
    table.upsert(changes(spark, [("a.0", "first", 1)]))
    with pytest.raises(Conflict):
        table._changed(stale, [0], table._rows(stale, [0]))
    assert dict(rows(table.read()))["a.0"] == "first"


def test_an_empty_table_and_an_emptied_one(spark):
    table = KeyedTable(spark, fresh_folder(spark, "keyed"))
    with pytest.raises(FileNotFoundError):
        table.read()
    table.create(spark.createDataFrame([], "key string, value string"))
    assert rows(table.read()) == [] and table.upsert(changes(spark, [("k", "v", 1)])) == 2
    assert table.purge(["k"]) == 3 and rows(table.read()) == [] and rows(table.read(2)) == [("k", "v")]
