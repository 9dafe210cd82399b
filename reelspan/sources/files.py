"""Readers: recordings, transcripts, markers, settings, templates, sound."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspan.functions.text import col, language, trimmed

VIDEO_GLOB = "*.{[mM][pP]4,[mM][kK][vV],[mM][oO][vV],[fF][lL][vV]}"
#: Seconds by which the window of a recording is widened on both sides.
EVENT_PADDING_SEC = 10
TRANSCRIPT_SCHEMA = "videoFileName string, videoPath string, transcriptionLanguage string, segments array<struct<startSec:double,endSec:double,text:string>>"


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified_at, size_bytes) of the videos in a folder, not below it; contents aren't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", VIDEO_GLOB).option("recursiveFileLookup", "false").load(folder)
    return found.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size_bytes"))


def modified_between(recordings: DataFrame, start, end) -> DataFrame:
    """Recordings modified within a window, both ends included, each path once, by path."""
    return recordings.where(F.col("modified_at").between(start, end)).dropDuplicates(["path"]).orderBy("path")


def or_last(found: DataFrame, last: DataFrame) -> DataFrame:
    """``found``, or where it is empty the last recording (path)."""
    there = F.broadcast(found.select("path").limit(1).groupBy().agg(F.count("*").alias("n")))
    return found.select("path").unionByName(last.crossJoin(there).where("n = 0").select("path"))


def folder_of(folder: Column | str, file: Column | str, last: Column | str) -> Column:
    """The recording folder: as set, else that of the file, else that of the last recording."""
    parent = lambda c: F.nullif(F.regexp_extract(col(c), r"^(.*)/[^/]*$", 1), F.lit(""))
    return F.coalesce(F.nullif(trimmed(folder), F.lit("")), parent(file), parent(last))


def recording_windows(events: DataFrame) -> DataFrame:
    """Pairs each start with the next stop of a session (session_id, event_no, kind, at) and widens
    the window; a start without a stop has no window."""
    order = W.partitionBy("session_id").orderBy("event_no")
    paired = events.withColumn("next_kind", F.lead("kind").over(order)).withColumn("next_at", F.lead("at").over(order))
    pad = F.expr(f"interval {EVENT_PADDING_SEC} seconds")
    return paired.where("kind = 'start' and next_kind = 'stop'").select("session_id", "event_no", (F.col("at") - pad).alias("start_at"), (F.col("next_at") + pad).alias("end_at"))


def transcripts(cache: DataFrame) -> DataFrame:
    """(key, seg_no, start_sec, end_sec, text) of a table of (key, value) whose values are transcript
    objects; missing numbers are 0, blank texts go, what doesn't parse has no rows."""
    parsed = cache.select("key", F.from_json("value", TRANSCRIPT_SCHEMA).alias("t"))
    rows = parsed.select("key", F.posexplode("t.segments").alias("seg_no", "s"))
    return rows.where(trimmed("s.text") != "").select("key", F.col("seg_no").cast("long").alias("seg_no"), F.coalesce("s.startSec", F.lit(0.0)).alias("start_sec"), F.coalesce("s.endSec", F.lit(0.0)).alias("end_sec"), trimmed("s.text").alias("text"))


def saved_markers(cache: DataFrame) -> DataFrame:
    """(key, marker_sec) of values such as ``1.000;2.500``: finite numbers not below 0."""
    parts = cache.select("key", F.explode(F.split("value", ";")).alias("p")).select("key", F.col("p").try_cast("double").alias("marker_sec"))
    return parts.where("marker_sec >= 0 and not isnan(marker_sec) and marker_sec < double('infinity')")


def saved_settings(cache: DataFrame) -> DataFrame:
    """(key, ranges, keywords, genre, model, clip_length_preset, source_language,
    transcription_language, ai_prompt, skip_curate) of review objects; keywords may be a list or a text parted by commas; defaults stand
    in for missing fields."""
    v = F.try_parse_json("value")
    text = lambda f, default: F.coalesce(F.try_variant_get(v, f"$.{f}", "string"), F.lit(default))
    listed = F.try_variant_get(v, "$.topicKeywords", "array<string>")
    parted = F.split(F.try_variant_get(v, "$.topicKeywords", "string"), ",")
    is_list = F.startswith(F.schema_of_variant(F.try_variant_get(v, "$.topicKeywords", "variant")), F.lit("ARRAY"))
    keywords = F.filter(F.transform(F.coalesce(F.when(is_list, listed).otherwise(parted), F.array().cast("array<string>")), trimmed), lambda k: k != "")
    ranges = F.transform(F.try_variant_get(v, "$.clipDurations", "array<struct<start:double,end:double>>"), lambda r: F.struct(r["start"].alias("start_sec"), r["end"].alias("end_sec")))
    return cache.select(
        "key", F.coalesce(ranges, F.array().cast("array<struct<start_sec:double,end_sec:double>>")).alias("ranges"), keywords.alias("keywords"),
        text("genre", "Auto").alias("genre"), text("model", "ClipAnything").alias("model"), text("clipLengthPreset", "Medium").alias("clip_length_preset"),
        text("sourceLanguage", "auto").alias("source_language"), language(text("transcriptionLanguage", "auto"), others=True).alias("transcription_language"), trimmed(text("aiPrompt", "")).alias("ai_prompt"), F.coalesce(F.try_variant_get(v, "$.skipCurate", "boolean"), F.lit(False)).alias("skip_curate"),
    )


def template_sections(lines: DataFrame) -> DataFrame:
    """(file, section, body) of files as (file, line_no, line) with ``[section]`` heads; line ends
    are normalised, bodies trimmed, text before the first head goes."""
    head = F.regexp_extract(trimmed("line"), r"^\[([^\]]+)\]$", 1)
    marked = lines.select("file", "line_no", F.regexp_replace("line", r"\r", "").alias("line")).withColumn("head", F.nullif(head, F.lit("")))
    order = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    inside = marked.withColumn("section", F.last("head", ignorenulls=True).over(order)).where("section is not null and head is null")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return inside.groupBy("file", "section").agg(trimmed(body).alias("body"))


def first_section(sections: DataFrame, candidates: DataFrame, section: str) -> DataFrame:
    """The body of a section in the first candidate file (priority, file) that has one."""
    has = sections.where((F.col("section") == section) & (F.col("body") != ""))
    return has.join(candidates, "file").agg(F.min_by("body", "priority").alias("body")).where("body is not null")


def first_existing(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Per name the first candidate (name, priority, path) that exists, else the first one."""
    marked = candidates.join(existing.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    rank = F.struct(F.when(F.col("there"), 0).otherwise(1).alias("a"), F.col("priority").alias("b"))
    return marked.groupBy("name").agg(F.min_by("path", rank).alias("path"), F.coalesce(F.bool_or("there"), F.lit(False)).alias("there"))


def search_paths(names: DataFrame, folders: list[str]) -> DataFrame:
    """(name, priority, path) of each model name in each folder, in order; an empty folder goes, one that
    recurs keeps its first place."""
    listed = F.array_distinct(F.filter(F.array(*map(F.lit, folders)), lambda f: f != ""))
    return names.select("name", F.posexplode(listed).alias("priority", "folder")).select("name", "priority", F.concat_ws("/", "folder", "name").alias("path"))


def template_candidates(variable: Column | str, module_folder: Column | str, working_folder: Column | str, file: str) -> Column:
    """The places of a template file in order: what a variable names, beside the module, in the working
    folder; blank ones go, one that recurs keeps its first place."""
    beside = lambda c: F.when(trimmed(c) != "", F.concat(trimmed(c), F.lit("/" + file)))
    return F.array_distinct(F.array_compact(F.array(F.nullif(trimmed(variable), F.lit("")), beside(module_folder), beside(working_folder))))


def file_parts(path: Column | str) -> Column:
    """Name, extension and MIME type of a path."""
    name = F.element_at(F.split(col(path), "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.struct(name.alias("name"), ext.alias("extension"), F.concat(F.lit("video/"), ext).alias("mime"))


def model_setting(setting: Column | str, model_exists: Column | str) -> Column:
    """The language model that is used: as set, but disabled where it is blank or there is no speech
    model."""
    set_ = trimmed(F.coalesce(col(setting), F.lit("")))
    return F.when((set_ == "") | ~F.coalesce(col(model_exists), F.lit(False)), "disabled").otherwise(set_)


def sound(files: DataFrame) -> DataFrame:
    """(stream_id, samples) of raw little-endian 32-bit float sound (stream_id, content); a trailing
    part of a sample is dropped, null content stays null."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                data = one.column(1)[0].as_py()
                values = pa.Array.from_buffers(pa.float32(), len(data or b"") // 4, [None, pa.py_buffer(data or b"")])
                held = pa.array([None], pa.list_(pa.float32())) if data is None else pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([one.column(0), held], names=["stream_id", "samples"])

    return files.select(F.col("stream_id").cast("long"), "content").mapInArrow(run, "stream_id long, samples array<float>")


def sound_range(pcm: DataFrame, start_sec: Column | str, length_sec: Column | str, rate: int = 16_000) -> DataFrame:
    """(stream_id, samples) of a stretch of each stream: from ``start_sec`` on, ``length_sec`` long, as
    far as there are samples; none before the beginning."""
    first = F.greatest(F.floor(col(start_sec) * rate), F.lit(0)).cast("int")
    count = F.greatest(F.floor(col(length_sec) * rate), F.lit(0)).cast("int")
    return pcm.select("stream_id", F.slice("samples", first + 1, count).alias("samples"))
