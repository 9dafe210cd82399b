"""Texts of segments move once, and not at all where lines are laid end to end."""

from pyspark.sql import functions as F

from reelspan.functions.text import word_count, words
from reelspan.operators import intervals as I
from reelspan.operators.scan import running_sums
from reelspan.plans import cases, catalogue, led
from reelspan.sources import derived


def rows(df):
    return sorted(tuple(r) for r in df.collect())



def test_segments_need_no_exchange_and_equal_those_of_parts(spark, small):
    texts = ["a b\n\n  c\t d  e \n" * 3, "", None, " \n\t", "\n".join(f"w {i}" for i in range(5000)), "one", "\u00a0x \u0085\ny"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(derived.segments(docs)) == rows(derived.segments_of_parts(docs)) and derived.segments(docs).count() > 5000
    whole = derived.segments(derived.table(spark, small, "documents"))
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()


def test_documents_in_several_rows_are_laid_together(spark):
    docs = spark.createDataFrame([(1, "a b\nc"), (1, "\n\nd e f"), (None, "x"), (None, "\ny")], "doc_id long, text string")
    assert [r[3] for r in derived.segments(docs).where("video_id = 1").orderBy("seg_no").collect()] == [1.0, 1.5, 3.0]


def test_sums_and_words_are_exact(spark):
    for n in (0, 1, 64, 65, 4096, 10_000):
        df = spark.createDataFrame([(list(range(n)),)], "v array<long>")
        assert df.select(running_sums(F.col("v"))).first()[0] == [i * (i + 1) // 2 for i in range(n)]
    texts = spark.createDataFrame([("",), (" ",), ("a",), ("a b",), ("a  b",), (" a\tb\n",), ("\u00e9 \u00e8 \x0b\x1c",)], "t string")
    assert all(r[0] == r[1] for r in texts.select(word_count("t"), F.size(words("t"))).collect())


def test_padded_ranges_are_one_cover_in_each_stretch(spark):
    ranges = spark.createDataFrame([(1, i, 100.0 + i, 700.0 - i) for i in range(200)] + [(2, 0, 900.0, 300.0)], "video_id long, range_no long, start_sec double, end_sec double")
    held = I.cover(ranges.withColumn("bucket", I.touched("start_sec", "end_sec")))
    assert held.where("video_id = 1").groupBy("bucket").count().agg(F.max("count")).first()[0] == 1
    s = spark.createDataFrame([(v, k, k * 10.0, k * 10.0 + 10.0, "t") for v in (1, 2) for k in range(100)], "video_id long, seg_no long, start_sec double, end_sec double, text string")
    near = [(r.video_id, r.seg_no) for r in s.collect() if any(q.video_id == r.video_id and r.end_sec > max(q.start_sec - 60, 0) and r.start_sec < q.end_sec + 60 for q in ranges.collect())]
    assert [(r.video_id, r.seg_no) for r in I.within_padding(s, ranges).orderBy("video_id", "seg_no").collect()] == near


def test_long_segments_do_not_take_their_text_along(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 9000.0, "x" * 1000), (2, 0, 0.0, 5.0, "y")], "video_id long, seg_no long, start_sec double, end_sec double, text string")
    r = spark.createDataFrame([(1, 0, 10.0, 4000.0)], "video_id long, range_no long, start_sec double, end_sec double")
    for made in (I.clip_to_first(s, r), I.remapped(s, r)):
        lines = [x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in x]
        assert lines and not any("text" in x for x in lines), lines
    assert rows(I.clip_to_first(s, r)) == [(1, 0, 10.0, 4000.0, "x" * 1000), (2, 0, 0.0, 5.0, "y")]


def test_led_requests_are_worked_out_once(spark, small):
    assert led.requests_of(spark, small) is led.requests_of(spark, small)


def test_the_second_round_reads_what_the_first_found(spark, small):
    plan = catalogue.QUERIES["prompt_ladder"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan.split("InMemoryRelation")[0] and plan.count("Join") <= 60 and cases.requests_of(spark, small).count() > 0
