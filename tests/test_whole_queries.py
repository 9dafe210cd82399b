"""Queries that judge whole texts."""

import hashlib

from pyspark.sql import functions as F

from reelspan.plans import catalogue


def write(spark, folder, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("web").alias("source"), F.length("text").cast("long").alias("n_chars")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "event_id long, user_id long, event_type string, ts timestamp").write.parquet(f"{folder}/events.parquet")


def test_whole_texts_are_judged(spark, tmp_path):
    long = "Find the lesson where " + "word " * 90
    write(spark, tmp_path, [long + "and after three minutes", "Find a lesson. She gives Anna Berg the key that unlocks the practice. Anna Berg uses this method as the key.", "", "plain"])
    got = {r["video_id"]: r["issues"].split("; ") for r in catalogue.QUERIES["prompt_issues"](spark, str(tmp_path)).collect()}
    assert "mentions duration or timestamps" in got[0] and got[2] == ["empty prompt"] and got[3] == ["prompt does not start with Find"]
    assert any("unlock method" in x for x in got[1]), got[1]


def test_ladder_repairs_and_finds_in_the_cache(spark, tmp_path):
    write(spark, tmp_path, ["the idea of short clips", "Anna Berg, " * 9 + "speaks: a long and especially mixed text"])
    got = {(r["request_id"], r["round"]): r for r in catalogue.QUERIES["prompt_ladder"](spark, str(tmp_path)).collect()}
    assert got[0, 1]["source"] == "model" and got[0, 1]["prompt"] == hashlib.md5(b"Find the idea of short clips").hexdigest()
    assert got[1, 1]["source"] == "repair" and got[0, 2]["source"] == got[1, 2]["source"] == "cache"
    assert got[1, 2]["prompt"] == got[1, 1]["prompt"]


def test_the_budget_is_that_of_the_operator(spark, tmp_path):
    write(spark, tmp_path, ["\n".join(["word " * 200] * 100)])
    got = [r["seg_no"] for r in catalogue.QUERIES["context_budget"](spark, str(tmp_path)).collect()]
    assert max(got) == 58 and len(got) == 59
