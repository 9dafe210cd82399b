"""The keyed store and its writers: a table of (key, value), one row a key, and what goes into it.

Changes are anti-joins and unions over the whole table, to be written beside it and swapped in;
sets of prefixes and of changes are joined, so neither is bounded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions.keys import language_key, ranges_identity
from reelspan.functions.text import decimals, is_gate_failure, language, trimmed
from reelspan.operators.intervals import remapped


def upserted(store: DataFrame, changes: DataFrame) -> DataFrame:
    """The store with the changes (key, value, change_no); of several for a key the last wins."""
    last = changes.groupBy("key").agg(F.max_by("value", "change_no").alias("value"))
    return store.join(last.select("key"), "key", "left_anti").unionByName(last)


def removed(store: DataFrame, keys: DataFrame) -> DataFrame:
    """The store without some keys."""
    return store.join(keys.select("key").distinct(), "key", "left_anti")


def purge_test(prefixes: list[str]) -> Column:
    """Whether a key begins with any of a stated list of prefixes, as written: ``a.`` isn't ``a_b``."""
    return reduce(lambda a, b: a | b, (F.startswith("key", F.lit(p)) for p in prefixes if p), F.lit(False))


def purged(store: DataFrame, prefixes: list[str]) -> DataFrame:
    """The store without the keys that begin with any prefix."""
    return store.where(~purge_test(prefixes))


def purge_count(store: DataFrame, prefixes: list[str]) -> DataFrame:
    """How many keys a purge removes."""
    return store.where(purge_test(prefixes)).agg(F.count("*").alias("n_removed"))


def values_or_default(keys: DataFrame, store: DataFrame) -> DataFrame:
    """(key, value) for (key, default_value); a missing or empty value is the default."""
    return keys.join(store, "key", "left").select("key", F.coalesce(F.nullif("value", F.lit("")), "default_value").alias("value"))


def transcript_objects(segments: DataFrame, videos: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """(video_id, value): transcripts as JSON, texts trimmed, blank ones gone. ``videos`` has video_id,
    path and language; with ranges (video_id, ranges) their identity is stored too."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "start_sec", "end_sec", trimmed("text").alias("text")))), lambda s: F.struct(s["start_sec"].alias("startSec"), s["end_sec"].alias("endSec"), s["text"].alias("text")))
    held = segments.where(trimmed("text") != "").groupBy("video_id").agg(rows.alias("segments")).join(videos, "video_id")
    fields = [F.element_at(F.split("path", "/"), -1).alias("videoFileName"), F.col("path").alias("videoPath"), language("language", others=True).alias("transcriptionLanguage")]
    if ranges is not None:
        held = held.join(ranges, "video_id")
        fields += [F.lit(True).alias("rangeTranscript"), ranges_identity("ranges").alias("rangeIdentity")]
    return held.select("video_id", F.to_json(F.struct(*fields, "segments")).alias("value"))


def marker_values(markers: DataFrame) -> DataFrame:
    """(video_id, value): sorted markers with 3 decimals, joined by ``;``. A video without markers has
    no row, so its key is to be removed."""
    return markers.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("marker_sec")), lambda m: decimals(m, 3)), ";").alias("value"))


def settings_objects(settings: DataFrame) -> DataFrame:
    """(key, value): review settings as JSON, in the form that ``saved_settings`` reads."""
    ranges = F.transform("ranges", lambda r: F.struct(r["start_sec"].alias("start"), r["end_sec"].alias("end")))
    return settings.select("key", F.to_json(F.struct(ranges.alias("clipDurations"), F.col("keywords").alias("topicKeywords"), "genre", "model", F.col("clip_length_preset").alias("clipLengthPreset"), F.col("source_language").alias("sourceLanguage"), F.col("transcription_language").alias("transcriptionLanguage"), F.col("ai_prompt").alias("aiPrompt"), F.col("skip_curate").alias("skipCurate"))).alias("value"))


def cacheable_prompts(prompts: DataFrame) -> DataFrame:
    """(key, value) of prompts that may be cached: neither blank nor gate failures."""
    return prompts.where((trimmed("value") != "") & ~is_gate_failure("value"))


def cached_prompts(keys: DataFrame, store: DataFrame) -> DataFrame:
    """(key, value, evict): cached prompts read through; a cached gate failure counts as none and is
    to be evicted."""
    hit = keys.join(store, "key", "left")
    bad = F.coalesce(is_gate_failure("value"), F.lit(False))
    return hit.select("key", F.when(bad, "").otherwise(F.coalesce(trimmed("value"), F.lit(""))).alias("value"), bad.alias("evict"))


def resampled_transcripts(transcripts: DataFrame, ranges: DataFrame, selected: Column | str) -> DataFrame:
    """Transcripts of a cut video for each distinct language of the selected one, auto, pt and en that
    has one: ``transcripts`` has video_id, language and the segment columns."""
    wanted = ranges.select("video_id").distinct().select("video_id", F.explode(F.array_distinct(F.array(language_key(selected), F.lit("auto"), F.lit("pt"), F.lit("en")))).alias("language"))
    kept = transcripts.join(wanted, ["video_id", "language"]).withColumn("video", F.struct("video_id", "language"))
    moved = remapped(kept.select(F.col("video").alias("video_id"), "seg_no", "start_sec", "end_sec", "text"), kept.select("video", F.col("video_id").alias("v")).distinct().join(ranges.withColumnRenamed("video_id", "v"), "v").select(F.col("video").alias("video_id"), "range_no", "start_sec", "end_sec"))
    return moved.select("video_id.video_id", "video_id.language", "seg_no", "start_sec", "end_sec", "text")


def concat_lines(paths: DataFrame) -> DataFrame:
    """(part_no, line) of a concatenation list: quoted paths, quotes in them escaped."""
    return paths.select("part_no", F.concat(F.lit("file '"), F.replace("path", F.lit("'"), F.lit("'\\''")), F.lit("'")).alias("line"))


def free_paths(wanted: DataFrame, existing: DataFrame, tries: int = 100, millis: Column | None = None) -> DataFrame:
    """Per (stem, extension) the first of ``tries`` paths that doesn't exist: without a number, then
    with -2, -3 and so on. When all exist, the one with ``millis``, the time of the run, unchecked; null without a time."""
    named = lambda suffix: F.concat("stem", suffix, F.lit("."), "extension")
    options = wanted.select("stem", "extension", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("k"))
    path = named(F.when(F.col("k") > 0, F.concat(F.lit("-"), (F.col("k") + 1).cast("string"))).otherwise(""))
    free = options.withColumn("path", path).join(existing.select("path"), "path", "left_anti")
    found = wanted.join(free.groupBy("stem", "extension").agg(F.min_by("path", "k").alias("path")), ["stem", "extension"], "left")
    return found if millis is None else found.withColumn("path", F.coalesce("path", named(F.concat(F.lit("-"), millis.cast("string")))))
