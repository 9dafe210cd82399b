"""Totals of ranges and transcripts, decisions over them, and sound level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspan.functions.text import credits, scope, trimmed

#: A clip this short, or a transcript this small, may have no strong clip.
SHORT_SEC, FEW_SEGMENTS, FEW_CHARS = 90.0, 8, 400
#: Bytes of sound that are looked at, and the levels from which it is audible.
AUDIBLE_BYTES, AUDIBLE_PEAK, AUDIBLE_RMS = 8 << 20, 1e-5, 1e-6
SAMPLE_RATE, CHUNK_SEC = 16_000, 20


def range_totals(ranges: DataFrame) -> DataFrame:
    """Per video: ranges, seconds (overlaps count twice, inverted ranges as 0) and credits."""
    total = F.sum(F.greatest(F.col("end_sec") - F.col("start_sec"), F.lit(0.0)))
    out = ranges.groupBy("video_id").agg(F.count("*").alias("n_ranges"), total.alias("total_sec"))
    return out.withColumn("credits", credits("total_sec"))


def transcript_totals(segments: DataFrame) -> DataFrame:
    """Per video: segments (blank ones too), characters of trimmed text, first start and last end."""
    return segments.groupBy("video_id").agg(
        F.count("*").alias("n_segments"), F.sum(F.length(trimmed("text"))).alias("n_chars"),
        F.min_by("start_sec", "seg_no").alias("first_sec"), F.max_by("end_sec", "seg_no").alias("last_sec"),
    )


def selected_duration(segments: DataFrame, ranges: DataFrame, overall: DataFrame) -> DataFrame:
    """Per video of ``overall``: the seconds of its positive ranges; where 0, of its overall range;
    where 0, from the first segment's start to the last one's end; never below 0. With the totals
    of the transcript, the scope and whether a lack of strong clips is believable."""
    chosen = ranges.groupBy("video_id").agg(F.sum(F.greatest(F.col("end_sec") - F.col("start_sec"), F.lit(0.0))).alias("chosen_sec"))
    both = overall.join(chosen, "video_id", "left").join(transcript_totals(segments), "video_id", "left")
    positive = lambda c: F.when(c > 0, c)
    duration = F.coalesce(positive(F.col("chosen_sec")), positive(F.col("range_end_sec") - F.col("range_start_sec")), positive(F.col("last_sec") - F.col("first_sec")), F.lit(0.0))
    n, chars = F.coalesce("n_segments", F.lit(0)), F.coalesce("n_chars", F.lit(0))
    out = both.select("video_id", duration.alias("selected_sec"), n.cast("long").alias("n_segments"), chars.cast("long").alias("n_chars"))
    weak = (F.col("selected_sec") < SHORT_SEC) | (F.col("n_segments") < FEW_SEGMENTS) | (F.col("n_chars") < FEW_CHARS)
    return out.withColumn("scope", scope("selected_sec")).withColumn("may_have_no_clip", weak)


def resample_decision(totals: DataFrame, threshold: Column | float = 60.0) -> DataFrame:
    """For (video_id, original_sec, selected_sec, n_ranges): the percentage that cutting would save
    and whether it is worth it: from the threshold on, with ranges, both lengths positive, and less
    selected than there is."""
    saved = F.when(F.col("original_sec") > 0, (F.col("original_sec") - F.col("selected_sec")) / F.col("original_sec") * 100).otherwise(0.0)
    limit = F.lit(threshold) if isinstance(threshold, float) else threshold
    ok = (F.col("n_ranges") > 0) & (F.col("original_sec") > 0) & (F.col("selected_sec") > 0) & (F.col("selected_sec") < F.col("original_sec"))
    return totals.withColumn("saved_percent", saved).withColumn("resample", ok & (F.col("saved_percent") >= limit))


def audible(pcm: DataFrame, samples: str = "samples") -> DataFrame:
    """Per stream: samples looked at (the first 8 MiB), peak, rms and whether there is sound. Samples
    that are not finite are skipped but count in the mean; no samples are silence; null samples (an
    unreadable stream) are sound."""
    head = F.slice(samples, 1, AUDIBLE_BYTES // 4)
    ok = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    clean = F.transform(F.filter(head, ok), lambda x: x.cast("double"))
    n = F.size(head)
    peak = F.aggregate(clean, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    rms = F.when(n > 0, F.sqrt(F.aggregate(clean, F.lit(0.0), lambda a, x: a + x * x) / n)).otherwise(0.0)
    out = pcm.select("stream_id", F.when(F.col(samples).isNull(), None).otherwise(n).cast("long").alias("n_samples"), peak.alias("peak"), rms.alias("rms"))
    return out.withColumn("audible", F.coalesce((F.col("peak") > AUDIBLE_PEAK) | (F.col("rms") > AUDIBLE_RMS), F.lit(True)))


def sound_chunks(pcm: DataFrame, samples: str = "samples", size: int = SAMPLE_RATE * CHUNK_SEC) -> DataFrame:
    """Cuts streams into chunks of ``size`` samples, the last one shorter: (stream_id, chunk_no,
    start_sec, samples)."""
    count = F.ceil(F.size(samples) / size).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    out = pcm.select("stream_id", samples, F.explode(numbers).alias("chunk_no"))
    return out.select("stream_id", F.col("chunk_no").cast("long").alias("chunk_no"), (F.col("chunk_no") * size / F.lit(float(SAMPLE_RATE))).alias("start_sec"), F.slice(samples, F.col("chunk_no") * size + 1, F.lit(size)).alias("samples"))


def resampled(pcm: DataFrame, from_rate: int, to_rate: int, samples: str = "samples") -> DataFrame:
    """Linear resampling in 32-bit floats: position i * from/to between two neighbours, the last
    sample repeating at the end; at least one sample comes out of a stream that isn't empty."""
    ratio = from_rate / to_rate
    n = F.size(samples)
    count = F.greatest(F.lit(1), F.floor(n / F.lit(ratio)).cast("int"))

    def at(i: Column) -> Column:
        place = i * F.lit(ratio)
        low = F.least(F.floor(place).cast("int"), n - 1)
        a, b = F.get(samples, low), F.get(samples, F.least(low + 1, n - 1))
        part = (place - low).cast("float")
        return (a + ((b - a).cast("float") * part).cast("float")).cast("float")

    out = F.when(F.lit(from_rate == to_rate) | (n == 0), F.col(samples)).otherwise(F.transform(F.sequence(F.lit(0), count - 1), at))
    return pcm.select("stream_id", out.alias("samples"))


def first_usable_stream(streams: DataFrame) -> DataFrame:
    """Per video the lowest stream that is audible and gave segments (video_id, stream_no, audible,
    n_segments)."""
    return streams.where("audible and n_segments > 0").groupBy("video_id").agg(F.min("stream_no").alias("stream_no"))


def stream_count(probe: DataFrame, text: str = "output") -> DataFrame:
    """Sound streams named in a probe's output, at least 1."""
    return probe.withColumn("n_streams", F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"Stream #0:\d+(?:\[[^\]]+\])?(?:\([^)]*\))?: Audio:"))))


def joined_ids(projects: DataFrame) -> DataFrame:
    """Per request the ids of its projects in order, joined by a comma."""
    parts = F.array_sort(F.collect_list(F.struct("project_no", "project_id")))
    return projects.groupBy("request_id").agg(F.array_join(F.transform(parts, lambda p: p["project_id"]), ", ").alias("project_ids"))


def range_table(ranges: DataFrame) -> DataFrame:
    """Ranges with a running number from 1, start, end and length, as they are shown."""
    number = F.row_number().over(W.partitionBy("video_id").orderBy("range_no"))
    return ranges.select("video_id", number.cast("long").alias("row_no"), "start_sec", "end_sec", (F.col("end_sec") - F.col("start_sec")).alias("length_sec"))
