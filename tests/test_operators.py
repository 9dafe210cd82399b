"""Edge cases that the tables don't reach, stated as literals."""

import struct

import pytest
from pyspark.sql import functions as F

from reelspan.functions import keys, rules, text
from reelspan.operators import aggregates as A
from reelspan.operators import entities as E
from reelspan.operators import intervals as I
from reelspan.operators import timeline as T
from reelspan.plans import prompts as P
from reelspan.sources import files, store
from reelspan.streaming import jobs

SEG, RNG, MRK = "video_id long, seg_no long, start_sec double, end_sec double, text string", "video_id long, range_no long, start_sec double, end_sec double", "video_id long, marker_sec double, marker_id long"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def lit(x):
    return F.lit(x)


def test_marker_pairing(spark):
    markers = spark.createDataFrame([(1, 50.0, 1), (1, 10.0, 2), (1, 200.0, 3), (2, 5.0, 1), (2, 5.0, 2), (3, 80.0, 1), (5, 1e9, 1)], MRK)
    lengths = spark.createDataFrame([(1, 250.0), (2, 100.0), (4, 30.0), (5, 10.0), (6, 0.0)], "video_id long, duration_sec double")
    assert rows(I.marker_ranges(markers, lengths), "video_id", "range_no", "start_sec", "end_sec") == [(1, 0, 10.0, 50.0), (1, 1, 200.0, 250.0), (3, 0, 80.0, 170.0), (4, 0, 0.0, 30.0)]


def test_first_range_wins_and_touching_is_no_overlap(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 10.0, "a"), (1, 1, 10.0, 20.0, "b"), (2, 0, 0.0, 1.0, "c")], SEG)
    rng = spark.createDataFrame([(1, 0, 8.0, 10.0), (1, 1, 0.0, 15.0)], RNG)
    assert rows(I.clip_to_first(seg, rng), "video_id", "seg_no", "start_sec", "end_sec") == [(1, 0, 8.0, 10.0), (1, 1, 10.0, 15.0), (2, 0, 0.0, 1.0)]
    assert rows(I.remapped(seg, rng), "seg_no", "start_sec", "end_sec") == [(0, 0.0, 2.0), (1, 2.0, 12.0), (2, 12.0, 17.0)]
    assert len(rows(I.bucketed_overlaps(seg, rng, 3.0), "seg_no")) == 3


def test_coalesce_merges_touching_and_nested(spark):
    rng = spark.createDataFrame([(1, 0, 20.0, 30.0), (1, 1, 0.0, 10.0), (1, 2, 10.0, 12.0), (1, 3, 21.0, 22.0), (1, 4, 9.0, 3.0)], RNG)
    once = I.coalesced(rng)
    assert rows(once, "range_no", "start_sec", "end_sec") == [(0, 0.0, 12.0), (1, 20.0, 30.0)]
    assert rows(I.coalesced(once), "start_sec", "end_sec") == [(0.0, 12.0), (20.0, 30.0)]
    assert rows(I.coalesced(rng, 5.0), "start_sec", "end_sec") == [(0.0, 35.0)]


def test_validations_differ_when_no_range_survives(spark):
    rng = spark.createDataFrame([(1, 0, 5.0, 5.0), (2, 0, -3.0, 2.0), (3, 0, 0.0, float("inf"))], RNG)
    overall = spark.createDataFrame([(i, 0.0, 9.0) for i in (1, 2, 4)], "video_id long, range_start_sec double, range_end_sec double")
    assert rows(I.usable(rng, overall), "video_id", "start_sec", "end_sec") == [(1, 0.0, 9.0), (2, -3.0, 2.0), (3, 0.0, float("inf")), (4, 0.0, 9.0)]
    assert rows(I.projected(rng, overall), "video_id") == [(2,), (3,), (4,)]
    assert rows(I.finite(rng, overall), "video_id", "start_sec", "end_sec") == [(2, 0.0, 2.0), (4, 0.0, 9.0)]


def test_nearest_marker_prefers_the_later_of_equals(spark):
    m = spark.createDataFrame([(1, 4.0, 1), (1, 6.0, 2)], MRK)
    p = spark.createDataFrame([(1, 7, 5.0), (1, 8, 99.0)], "video_id long, point_id long, point_sec double")
    assert rows(I.nearest_marker(p, m, 2.0), "point_id", "marker_id") == [(7, 2)]


def test_points_are_held_at_both_ends(spark):
    rng = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 5.0, 9.0)], RNG)
    p = spark.createDataFrame([(1, 0, 5.0), (1, 1, 9.0), (1, 2, 9.5)], "video_id long, point_id long, point_sec double")
    assert rows(I.range_at(p, rng), "point_id", "start_sec", "end_sec") == [(0, 0.0, 5.0), (1, 5.0, 9.0), (2, 9.5, 99.5)]


def test_windows_keep_late_segments(spark):
    seg = spark.createDataFrame([(1, 0, 299.999, 301.0, " "), (1, 1, 300.0, 310.0, "a"), (1, 2, 10.0, 20.0, "late"), (1, 3, 900.0, 901.0, "b")], SEG)
    assert rows(T.window_totals(seg), "window_sec", "n_segments") == [(300.0, 2), (900.0, 1)]


@pytest.mark.parametrize(("pieces", "want"), [(["a" * 520, "b"], "a" * 520), (["a" * 519, "b"], "a" * 519 + " ..."), (["a" * 600], "a" * 520 + "..."), (["a", " ", "b"], "a b")])
def test_preview(spark, pieces, want):
    assert one(spark, T.preview(F.array(*map(lit, pieces)))) == want


def test_budget_keeps_the_line_that_reaches_it(spark):
    seg = spark.createDataFrame([(1, i, 0.0, 1.0, "x" * 10) for i in range(5)], SEG)
    assert rows(T.within_budget(seg, 50), "seg_no", "cut") == [(0, False), (1, True)]


@pytest.mark.parametrize(("value", "places", "want"), [(0.125, 2, "0.12"), (1.005, 2, "1.00"), (2.675, 2, "2.67"), (-0.001, 2, "-0.00"), (1234567.5, 0, "1234568")])
def test_decimals(spark, value, places, want):
    assert one(spark, text.decimals(lit(value), places)) == want


def test_clocks(spark):
    assert one(spark, text.clock(lit(59.5), rounded=True)) == "00:01:00" and one(spark, text.clock(lit(59.5), rounded=False)) == "00:00:59"
    assert one(spark, text.clock(lit(360_000.0), rounded=False)) == "100:00:00"


@pytest.mark.parametrize(("value", "want"), [("", 60.0), ("x", 60.0), ("150", 100.0), ("-1", 0.0), (" 42.5 ", 42.5)])
def test_threshold(spark, value, want):
    assert one(spark, text.resample_threshold(lit(value))) == want


def test_scope_edges(spark):
    got = [one(spark, text.scope(lit(s))) for s in (599.999, 600.0, 2399.999, 2400.0)]
    assert [g.split("_")[0] for g in got] == ["short", "medium", "medium", "large"]


def test_sound_levels(spark):
    pcm = spark.createDataFrame([(1, []), (2, [0.0, 0.0]), (3, [float("nan"), 1e-5]), (4, [0.5]), (5, None)], "stream_id long, samples array<float>")
    assert rows(A.audible(pcm), "stream_id", "audible") == [(1, False), (2, False), (3, True), (4, True), (5, True)]
    assert rows(A.resampled(spark.createDataFrame([(1, [0.0, 1.0, 2.0, 3.0])], "stream_id long, samples array<float>"), 2, 4), "samples") == [([0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.0],)]
    raw = spark.createDataFrame([(1, struct.pack("<2f", 0.5, -1.0) + b"x"), (2, None)], "stream_id long, content binary")
    assert files.sound(raw).orderBy("stream_id").collect()[0]["samples"] == [0.5, -1.0]


def test_names_merge_and_rank():
    grown = E.grown({"Anna Maria": 1, "Maria Lopez": 2, "Lopez School": 1})
    assert grown["Anna Maria Lopez"] == 3 and grown["Anna Maria Lopez School"] >= 4
    assert E.ranked(grown)[0][0] == "Anna Maria Lopez School" and len(E.ranked(grown)) == 1
    assert len(E.ranked({f"Name{c} Other{c}": 1 for c in "abcdefgh"})) == 6


def test_name_counts(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 1.0, "we met doctor Anna Maria. The Big One came; and Émile Zola; mit Stteä Haus")], SEG)
    assert rows(E.name_counts(seg), "name", "n") == [("Anna Maria", 1), ("Doctor Anna Maria", 2), ("Mit Stteä Haus", 2), ("Stteä Haus", 1)]


RULES = {
    "Look for it.": "prompt does not start with Find", "Find " + "a " * 95: "too verbose", "Find a. B. C. D. e": "3-sentence", "Find especially": "especially", "Find a: b": "colon", "Find also look for": "second search",
    "Find the speaker and his dog": "gender", "Find why it matters and how it works": "broad alternative", "Find a or b or c": "OR alternatives", "Find a,b,c,d,e,f,g,h": "topic catalog", "Find method roadmap": "method/routine with roadmap",
    "Find method roadmap gpt": "method, tools", "Find method challenge": "motivation/challenge", "Find method challenge roadmap": "motivation, method", "Find seconds": "duration", "Find a and b and c and d and e and f": "short clip",
}


@pytest.mark.parametrize("prompt", RULES)
def test_rules(spark, prompt):
    found = one(spark, rules.issues(lit(prompt), lit("short_range_best_moment"), F.array().cast("array<string>"), lit(False), lit(False)))
    assert any(RULES[prompt] in f for f in found)


def test_rules_on_transcripts(spark):
    names = F.array(lit("Anna Maria Lopez"))
    ask = lambda p, pronoun, unlock: one(spark, rules.issues(lit(p), lit("x"), names, lit(pronoun), lit(unlock)))
    assert ask("Find the idea", True, False) == ["drops a named reference needed to resolve pronouns or indirect references"]
    assert ask("Find anna maria's idea", True, False) == [] == ask("Find it", False, False)
    assert len(ask("Find input, making sure", False, True)) == 2
    assert ask("  ", True, True) == ["empty prompt"]


def test_plans(spark):
    read = lambda raw: one(spark, P.rendered_plan(P.plan_object(lit(raw)), lit("short_range_best_moment"), lit("the default")))
    assert read("[1]") is None and read("{}") is None and read("no json") is None
    assert "explains the default." in read('{"main_target": 5, "x": 1}')
    assert read('{"no_strong_clip_found": true}').startswith("NO_STRONG_CLIP_FOUND: No complete")
    assert "tells a story with a dog." in read('so: {"plan": {"arc_type": "Story", "main_target": "the speaker tells a story", "context_phrase": "with a dog;"}} ok')
    reply = lambda raw, may: one(spark, P.normalized_reply(lit(raw), lit("x"), lit(may), lit("t"), F.array(lit("k"))))
    assert reply("NO_STRONG_CLIP_FOUND: none", True) == "NO_STRONG_CLIP_FOUND: none" and "about k." in reply("NO_STRONG_CLIP_FOUND: none", False)
    assert reply("x\nopus_prompt: Find it ", True) == "Find it" and reply("  ", True) == "" and reply("plain", True) == "plain"


def test_replies(spark):
    body = '{"choices":[{"message":{"content":" "}},{"message":{"content":" b "}}],"output_text":"c"}'
    assert one(spark, P.reply_text(lit(body))) == "b" and one(spark, P.reply_text(lit("junk"))) == ""
    assert one(spark, P.project_id(lit('{"id":" ","project":{"id":"p"}}'), lit("f"))) == "p" and one(spark, P.project_id(lit("[]"), lit("f"))) == "f"


def test_filling_expands_inserted_names(spark):
    assert one(spark, P.filled(lit("{{a}}-{{b}}"), {"a": lit("{{b}}"), "b": lit("x")})) == "x-x"


def test_store(spark):
    s = spark.createDataFrame([("gpt_prompt.1", "a"), ("gpt_prompt_input.v15.1", "NO_STRONG_CLIP_FOUND: x"), ("k", "")], "key string, value string")
    assert rows(store.purged(s, ["gpt_prompt."]), "key") == [("gpt_prompt_input.v15.1",), ("k",)] and store.purge_count(s, ["gpt_prompt."]).first()[0] == 1
    assert rows(store.cached_prompts(s.select("key"), s), "key", "value", "evict")[1] == ("gpt_prompt_input.v15.1", "", True)
    defaults = spark.createDataFrame([("k", "d"), ("none", "e")], "key string, default_value string")
    assert rows(store.values_or_default(defaults, s), "key", "value") == [("k", "d"), ("none", "e")]
    want = spark.createDataFrame([("v", "mp4")], "stem string, extension string")
    assert store.free_paths(want, spark.createDataFrame([("v.mp4",), ("v-2.mp4",)], "path string")).first()["path"] == "v-3.mp4"
    taken = spark.createDataFrame([("v.mp4",), ("v-2.mp4",)], "path string")
    assert store.free_paths(want, taken, 2).first()["path"] is None and store.free_paths(want, taken, 2, F.lit(1700)).first()["path"] == "v-1700.mp4"


def test_settings_round_trip(spark):
    made = spark.createDataFrame([("k", '{"clipDurations":[{"start":1.5,"end":2}],"topicKeywords":" a, b ,","skipCurate":true}'), ("l", '{"topicKeywords":["x"," "]}'), ("m", "junk")], "key string, value string")
    got = files.saved_settings(made)
    assert [(r["keywords"], r["skip_curate"], len(r["ranges"])) for r in got.orderBy("key").collect()] == [(["a", "b"], True, 1), (["x"], False, 0), ([], False, 0)]
    again = files.saved_settings(store.settings_objects(got))
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))


def test_templates(spark):
    lines = spark.createDataFrame([("f", 0, "lost"), ("f", 1, "[a]"), ("f", 2, "one\r"), ("f", 3, "two"), ("f", 4, "[b]"), ("g", 0, "[b]"), ("g", 1, "deep")], "file string, line_no long, line string")
    s = files.template_sections(lines)
    assert ("f", "a", "one\ntwo") in rows(s, "file", "section", "body")
    order = spark.createDataFrame([("f", 0), ("g", 1)], "file string, priority int")
    assert files.first_section(s, order, "b").first()[0] == "deep" and files.first_section(s, order, "c").count() == 0


def test_recordings(spark, tmp_path):
    for name in ("a.mp4", "b.MKV", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    found = files.recordings(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for (p,) in rows(found, "path")] == ["a.mp4", "b.MKV"]
    edge = found.agg(F.min("modified_at"), F.max("modified_at")).first()
    assert files.modified_between(found, edge[0], edge[1]).count() == 2
    last = spark.createDataFrame([("z",)], "path string")
    assert files.or_last(found.where("false"), last).count() == 1 and files.or_last(found, last).count() == 2


def test_keys(spark):
    long_name = "/v/" + "ü" * 60 + ".mp4"
    assert "\n" not in one(spark, keys.markers_key(lit(long_name))) and "=" not in one(spark, keys.markers_key(lit(long_name)))
    ranges = lambda *r: F.array(*[F.struct(lit(a).alias("start_sec"), lit(b).alias("end_sec")) for a, b in r])
    assert one(spark, keys.ranges_identity(ranges((0.0, 1.0), (2.0, 3.0)))) != one(spark, keys.ranges_identity(ranges((2.0, 3.0), (0.0, 1.0))))
    by_range, by_marker = one(spark, keys.review_key_of_ranges(lit("/a"), ranges((0.0, 1.0)))), one(spark, keys.review_key_of_markers(lit("/a"), F.array(lit(0.0), lit(1.0))))
    assert by_range.endswith(".0-1000") and by_marker.endswith(".0_1000")


def test_jobs(spark):
    log = spark.createDataFrame([(1, 1, "running", 10, "go"), (2, 1, "succeeded", 100, " "), (3, 2, "pending", 0, ""), (4, 3, "failed", 7, "bad")], "seq long, job_id long, state string, progress long, message string")
    states = jobs.job_states(log)
    assert rows(states, "job_id", "state", "message")[0] == (1, "succeeded", "go")
    assert jobs.batch_outcome(states).first()["outcome"] == "running"
    assert jobs.batch_outcome(jobs.after_cancel(states)).first()["outcome"] == "canceled"
    assert one(spark, jobs.phase_progress(lit(51), lit(True))) == 75


def test_job_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"seq":1,"job_id":1,"state":"running","progress":5,"message":"m"}\n{"seq":2,"job_id":1,"state":"succeeded","progress":100,"message":""}\n')
    stream = jobs.job_states(jobs.event_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("job_states_test").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert rows(spark.table("job_states_test"), "job_id", "state", "message") == [(1, "succeeded", "m")]


def test_probe_and_model(spark):
    probe = spark.createDataFrame([(1, "Stream #0:1(und): Audio: aac\nStream #0:2[0x1]: Audio: aac\nStream #0:0: Video: h"), (2, "")], "video_id long, output string")
    assert rows(A.stream_count(probe), "video_id", "n_streams") == [(1, 2), (2, 1)]
    assert [one(spark, files.model_setting(lit(m), lit(there))) for m, there in ((" m ", True), ("m", False), (" ", True))] == ["m", "disabled", "disabled"]
    found = files.search_paths(spark.createDataFrame([("tiny",)], "name string"), ["/a", "/b", "/a"])
    assert files.first_existing(found, spark.createDataFrame([("/b/tiny",)], "path string")).first()["path"] == "/b/tiny"
    assert files.first_existing(found, spark.createDataFrame([], "path string")).first()["path"] == "/a/tiny"
    assert tuple(one(spark, files.file_parts(lit("/x/A.b.MKV")))) == ("A.b.MKV", "mkv", "video/mkv")


def test_empty_tables(spark):
    seg, rng, mrk = (spark.createDataFrame([], s) for s in (SEG, RNG, MRK))
    lengths = spark.createDataFrame([], "video_id long, duration_sec double")
    for df in (I.marker_ranges(mrk, lengths), I.clip_to_first(seg, rng), I.coalesced(rng), I.remapped(seg, rng), T.window_previews(seg), T.timeline_text(seg), E.top_names(seg), E.reference_facts(seg), A.range_totals(rng), A.transcript_totals(seg), store.marker_values(mrk)):
        assert df.count() == 0


def test_one_very_long_video(spark):
    """A million segments of one video: what is near meets, nothing else does."""
    n = 1_000_000
    seg = spark.range(n).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("seg_no"), F.col("id").cast("double").alias("start_sec"), (F.col("id") + 1).cast("double").alias("end_sec"), F.lit("x").alias("text"))
    rng = spark.range(2000).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("range_no"), (F.col("id") * 400.0 + 0.5).alias("start_sec"), (F.col("id") * 400.0 + 3.5).alias("end_sec"))
    assert I.clip_to_first(seg, rng).count() == 2000 * 4 == I.remapped(seg, rng).count()
    assert I.within_padding(seg, rng, 5.0).count() == 9 + 1999 * 14
    points = seg.select("video_id", F.col("seg_no").alias("point_id"), (F.col("start_sec") + 0.6).alias("point_sec"))
    assert I.range_at(points, rng).where("range_no is not null").count() == 2000 * 3
    markers = rng.select("video_id", F.col("start_sec").alias("marker_sec"), F.col("range_no").alias("marker_id"))
    assert I.nearest_marker(points, markers, 0.2).count() == 2000


def test_names_by_index_equal_all_pairs():
    """The index finds what all pairs, merged until nothing changes, give."""
    from itertools import combinations

    def plain(counts):
        counts, changed = dict(counts), True
        while changed:
            changed = False
            for a, b in combinations(sorted(counts), 2):
                both = E.merged(a.split(), b.split())
                if max(len(a.split()), len(b.split())) < len(both) <= E.MOST_WORDS and counts.get(" ".join(both), 0) < counts[a] + counts[b]:
                    counts[" ".join(both)], changed = counts[a] + counts[b], True
        return counts

    import random

    rng = random.Random(2)
    for _ in range(60):
        made = {" ".join(rng.choice(("Ann", "ann", "Bo", "Cy", "Di", "Ed")) for _ in range(rng.randint(2, 5))): rng.randint(1, 4) for _ in range(rng.randint(0, 7))}
        assert E.grown(made) == plain(made)


def test_derived_tables_are_worked_out_once(spark, small):
    from reelspan.plans import catalogue

    assert catalogue.segments_of(spark, small) is catalogue.segments_of(spark, small)
    plan = catalogue.QUERIES["clip_transcript"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("InMemoryRelation")[0].count("FileScan") == 0


def test_derived_tables_follow_their_files(spark, tmp_path):
    """A folder that is written anew gives its new rows; what is held can be let go."""
    from reelspan.plans import catalogue
    from reelspan.sources import derived

    folder = str(tmp_path / "data")
    write = lambda text: spark.createDataFrame([(1, text, "en", "web", len(text))], "doc_id long, text string, lang string, source string, n_chars int").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    write("one\ntwo")
    first = catalogue.segments_of(spark, folder)
    assert first.count() == 2 and catalogue.segments_of(spark, folder) is first and first.is_cached
    write("one\ntwo\nthree words here")
    assert catalogue.segments_of(spark, folder).count() == 3 and not first.is_cached
    second = catalogue.segments_of(spark, folder)
    assert derived.release(spark) >= 1 and not second.is_cached
