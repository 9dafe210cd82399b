"""Texts put together within a row equal those put together from tables."""

import random

from pyspark.sql import functions as F

from reelspan.functions import rules, text
from reelspan.operators import entities as E
from reelspan.operators import intervals as I
from reelspan.operators import lines as L
from reelspan.operators import timeline as T
from reelspan.plans import catalogue
from reelspan.sources import derived

TEXTS = [
    "one two\n\n  three\t four  five \n" * 40, "", None, " \n\t", "\n".join(f"word {i} " + "x" * (i % 700) for i in range(900)), "a", "\n".join("w" for _ in range(5000)), "y" * 60_000, "z" * 59_985, "z" * 59_984,
    "z" * 59_984 + "\nq", "x " * 519 + "\n1", "éè Anna Berg\r tells\x0b of Anna Berg \u0085\nend",
]
RANGES = [(0, 0, 0.0, 20.0), (0, 1, 10.0, 12.0), (0, 2, 5.0, 90.0), (4, 0, 700.0, 800.0), (4, 1, 100.0, 150.25), (5, 0, 0.5, 9.0), (6, 0, 0.0, 3000.0), (10, 0, 0.0, 1.0), (11, 0, 250.0, 250.0), (11, 1, 260.0, 255.0), (99, 0, 0.0, 1.0)]


def tables(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    shape = "video_id long, range_no long, start_sec double, end_sec double"
    r = spark.createDataFrame(RANGES + [(7, 0, 0.0, 0.5), (8, 0, 0.0, 0.5), (9, 0, 0.0, 0.5), (6, 1, 1.0, 2.0)], shape)
    listed = r.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("range_no", "start_sec", "end_sec"))), lambda x: F.struct(x["start_sec"].alias("start_sec"), x["end_sec"].alias("end_sec"))).alias("ranges"))
    return docs, r, listed


def pairs(df):
    return {r[0]: r[1] for r in df.collect() if r[1]}


def test_texts_of_rows_equal_those_of_tables(spark):
    docs, r, listed = tables(spark)
    s, held = derived.segments(docs), derived.lined(docs, listed)
    for of_rows, of_tables in ((L.timeline_of("lines"), T.timeline_text(s)), (L.context_of("lines", "ranges"), T.context_text(I.within_padding(s, r))), (L.transcript_of("lines", "ranges"), T.transcript_text(I.clip_to_first(s, r)))):
        assert pairs(held.select("video_id", of_rows)) == pairs(of_tables)
    assert any(T.NOTE in x for x in pairs(held.select("video_id", L.context_of("lines", "ranges"))).values())


def test_documents_in_several_rows_have_one_list(spark):
    docs = spark.createDataFrame([(1, "a b\nc"), (1, "\n\nd e f"), (None, "x"), (2, "y")], "doc_id long, text string")
    got = derived.lined(docs).select("video_id", F.transform("lines", lambda x: x["end_sec"]).alias("ends")).collect()
    assert sorted((r[0] or 0, r[1]) for r in got) == [(0, None), (1, [1.0, 1.5, 3.0]), (1, [1.0, 1.5, 3.0]), (2, [0.5])]
    assert [r.lines for r in derived.lined(docs.where("doc_id is null")).collect()] == [None]


def test_durations_need_no_segments(spark):
    docs, _, _ = tables(spark)
    assert pairs(derived.text_durations(docs)) == pairs(derived.durations(derived.segments(docs)))


def test_dependence_needs_names(spark):
    df = spark.createDataFrame([(["A B"], "She TEACHES one key, the way she does"), ([], "she teaches one key"), (None, "x"), (["A B"], "plain")], "names array<string>, t string")
    assert [tuple(r[0]) for r in df.select(E.depends("names", F.col("t"))).collect()] == [(True, True), (False, False), (False, False), (False, False)]


def test_counts_of_rules_stop_early_and_are_exact(spark):
    random.seed(7)
    texts = ["".join(random.choice((" or ", " and ", "a", "or ", "and ", ", ", ". ", "\n", "  \t", " ")) for _ in range(random.randrange(40))) for _ in range(300)] + ["a or or b", "a and and and and and b", "w " * 95 + "w", "w " * 94 + "w"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("n", text.simplified("t"))
    for r in df.select("t", "n", rules.at_least(F.col("n"), " or ", 2), rules.at_least(F.col("n"), " and ", 5), rules.more_than(F.col("n"), ",", 6), rules.more_than(F.col("n"), ". ", 2), rules.more_than(F.col("n"), " ", 94)).collect():
        n = " ".join(r[0].split())
        assert tuple(r)[1:] == (n, n.count(" or ") >= 2, n.count(" and ") >= 5, n.count(",") >= 7, n.count(". ") > 2, len(n.split(" ")) > 95)


def held_by(spark, small, name):
    derived.release(spark)
    assert catalogue.QUERIES[name](spark, small).count() > 0
    return {k[2] for k in derived._held if k[0] == spark.sparkContext.applicationId}


def test_input_prompts_holds_no_texts(spark, small):
    assert held_by(spark, small, "input_prompts") <= {"ranges", "durations"}


def test_rendered_inputs_holds_no_texts(spark, small):
    from reelspan.plans import rendered  # noqa: F401

    assert held_by(spark, small, "rendered_inputs") <= {"ranges", "durations"}


def test_prompt_issues_holds_no_texts(spark, small):
    from reelspan.plans import cases  # noqa: F401

    assert held_by(spark, small, "prompt_issues") <= {"ranges", "durations"}
