"""Ordered folds of a transcript: time windows with previews, and character budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions.text import MOST_CONTEXT_CHARS, PREVIEW_CHARS, WINDOW_SEC, decimals, segment_line, trimmed
from reelspan.operators.intervals import TIMES, with_texts
from reelspan.operators.scan import Fold, dense, running

#: What follows a context that was cut.
NOTE = "\n\n[context truncated to keep the GPT request focused]"


def windowed(segments: DataFrame, size: float = WINDOW_SEC) -> DataFrame:
    """Adds the start of the tumbling window of each segment. The first segment, blank or not, sets
    the first window; a segment that steps back stays in the window that was open. Blank ones go."""
    filled = trimmed("text") != ""
    start = F.greatest(F.floor(F.col("start_sec") / size) * size, F.lit(0.0))
    held = running(segments, ["video_id"], ["seg_no"], dense("seg_no"), {"opened_sec": Fold("first", F.coalesce(start, F.lit(0.0))), "latest_sec": Fold("max", F.when(filled, start))})
    return held.where(filled).withColumn("window_sec", F.greatest("opened_sec", "latest_sec")).drop("opened_sec", "latest_sec")


def window_totals(segments: DataFrame, size: float = WINDOW_SEC) -> DataFrame:
    """Per video and window: segments, first start and last end."""
    return windowed(segments, size).groupBy("video_id", "window_sec").agg(F.count("*").alias("n_segments"), F.min("start_sec").alias("first_sec"), F.max("end_sec").alias("last_sec"))


def preview(texts: Column, limit: int = PREVIEW_CHARS) -> Column:
    """Joins ordered texts by spaces until ``limit`` characters; the piece that doesn't fit is cut,
    trimmed and marked with three dots, and nothing follows it."""

    def add(held: Column, piece: Column) -> Column:
        text = trimmed(piece)
        lead = F.when(held == "", held).otherwise(F.concat(held, F.lit(" ")))
        room = F.greatest(F.lit(limit) - F.length(lead), F.lit(0))
        cut = F.concat(trimmed(F.substring(text, F.lit(1), room)), F.lit("..."))
        grown = F.concat(lead, F.when(F.length(text) <= room, text).otherwise(cut))
        return F.when((text == "") | (F.length(held) >= limit), held).otherwise(grown)

    return F.aggregate(texts, F.lit(""), add)


def window_previews(segments: DataFrame, size: float = WINDOW_SEC, limit: int = PREVIEW_CHARS) -> DataFrame:
    """Per video and window the preview of its text. Only the rows that a preview may show are collected."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "text"))), lambda s: s["text"])
    bare = segments.select(*TIMES, F.left(trimmed("text"), F.lit(1)).alias("text"), F.length(trimmed("text")).alias("chars"))  # whether it is blank, and its length
    held = running(windowed(bare, size), ["video_id", "window_sec"], ["seg_no"], dense("seg_no"), {"chars_before": Fold("sum", F.col("chars") + 1, own=False)})
    shown = with_texts(held.where(F.coalesce("chars_before", F.lit(0)) <= limit).drop("text"), segments)
    grouped = shown.groupBy("video_id", "window_sec").agg(texts.alias("texts"))  # at most limit pieces
    return grouped.select("video_id", "window_sec", trimmed(preview(F.col("texts"), limit)).alias("preview"))


def timeline_text(segments: DataFrame, size: float = WINDOW_SEC, limit: int = PREVIEW_CHARS) -> DataFrame:
    """Per video the lines of its window previews."""
    line = F.concat(F.lit("["), decimals("window_sec", 0), F.lit("s-"), decimals(F.col("window_sec") + size, 0), F.lit("s] "), F.col("preview"))
    lines = window_previews(segments, size, limit).where("preview <> ''").select("video_id", F.struct("window_sec", line.alias("line")).alias("l"))
    return lines.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("timeline"))


def within_budget(segments: DataFrame, budget: int = MOST_CONTEXT_CHARS) -> DataFrame:
    """Segments whose lines begin before ``budget`` characters are reached; the line that reaches it
    is kept. Adds the line, its running length with line feeds, and whether it is the cut."""
    lines = segments.where(trimmed("text") != "").withColumn("line", segment_line("start_sec", "end_sec", "text"))
    counted = running(lines, ["video_id"], ["seg_no"], dense("seg_no"), {"running_chars": Fold("sum", F.length("line") + 1)})
    kept = counted.where(F.col("running_chars") - F.length("line") - 1 < budget)
    return kept.withColumn("cut", F.col("running_chars") >= budget)


def channel_timeline(segments: DataFrame, videos: DataFrame, videos_held: int = 64, first_chars: int | None = None) -> DataFrame:
    """All videos of a channel (video_id, channel) laid end to end by id: (channel, video_id, seg_no, start_sec, end_sec,
    running_chars) with times of the channel and the characters of its texts so far, a line feed each. A
    channel is as many tasks' work as it has stretches of ``videos_held`` ids. With ``first_chars`` only segments before which there are
    fewer characters."""
    placed = segments.select("video_id", "seg_no", "start_sec", "end_sec", F.length("text").alias("chars")).join(videos.select("video_id", "channel"), "video_id")  # texts stay
    length = F.col("end_sec") - F.col("start_sec")
    folds = {"until_sec": Fold("sum", length), "running_chars": Fold("sum", F.col("chars") + 1)}
    laid = running(placed, ["channel"], ["video_id", "seg_no"], dense("video_id", videos_held), folds)
    if first_chars is not None:
        laid = laid.where(F.col("running_chars") - F.col("chars") - 1 < first_chars)
    return laid.select("channel", "video_id", "seg_no", (F.col("until_sec") - length).alias("start_sec"), F.col("until_sec").alias("end_sec"), "running_chars")


def transcript_text(segments: DataFrame) -> DataFrame:
    """Per video the lines of its segments; blank ones go."""
    lines = segments.where(trimmed("text") != "").select("video_id", F.struct("seg_no", segment_line("start_sec", "end_sec", "text").alias("line")).alias("l"))
    return lines.groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("transcript"))


def context_text(segments: DataFrame, budget: int = MOST_CONTEXT_CHARS) -> DataFrame:
    """Per video the lines within the budget, and a note where there was more."""
    kept = within_budget(segments, budget).select("video_id", "cut", F.struct("seg_no", "line").alias("l"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n")
    note = F.when(F.bool_or("cut"), NOTE).otherwise("")
    return kept.groupBy("video_id").agg(F.concat(text, note).alias("context"))
