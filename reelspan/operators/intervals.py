"""Interval algebra over a time-stamped transcript.

Tables: segments (video_id, seg_no, start_sec, end_sec, text), ranges (video_id, range_no,
start_sec, end_sec), markers (video_id, marker_sec, marker_id). Joins of times have the equality on
``video_id`` and a stretch of time, with the overlap as residual condition, so only what lies near each
other meets, however long a video is; windows partition by keys that begin with ``video_id``.
Overlap is strict: touching intervals do not overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelspan.operators.scan import Fold, dense, running, timed

#: Seconds that an unpaired last marker opens, and that a video without markers gets.
DEFAULT_CLIP_SEC = 90.0
#: Marker distance that counts as equal, and pixels within which a marker is hit.
SAME_MARKER_SEC, HIT_PIXELS = 0.01, 10.0
#: What intervals are joined by; texts are joined to what is found.
TIMES = ("video_id", "seg_no", "start_sec", "end_sec")
#: Seconds of a stretch by which intervals are joined.
STRETCH_SEC = 300.0


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    """Whether two intervals share more than a point."""
    return (F.col(a_end) > F.col(b_start)) & (F.col(a_start) < F.col(b_end))


def marker_ranges(markers: DataFrame, durations: DataFrame) -> DataFrame:
    """Pairs sorted markers into ranges: first with second, third with fourth; an odd last one opens
    DEFAULT_CLIP_SEC. Ranges are clamped to the duration (video_id, duration_sec) where it is known
    and positive; empty ones go, the numbers of the others stay, so range i comes from markers 2i and
    2i+1. A video with a duration and no markers has one default range."""
    numbered = running(markers, ["video_id"], ["marker_sec", "marker_id"], timed("marker_sec", STRETCH_SEC), {"nth": Fold("count", F.lit(1), own=False)})
    pairs = (
        numbered.withColumn("range_no", F.floor(F.col("nth") / 2).cast("long"))
        .groupBy("video_id", "range_no")
        .agg(F.min("marker_sec").alias("low"), F.max("marker_sec").alias("high"), F.count("*").alias("n"))
    )
    known = durations.where("duration_sec > 0").select("video_id", "duration_sec")
    end = F.when(F.col("n") == 2, F.col("high")).otherwise(F.col("low") + DEFAULT_CLIP_SEC)
    limit = F.coalesce("duration_sec", F.lit(float("inf")))
    start = F.when(F.col("duration_sec").isNull(), F.col("low")).otherwise(F.greatest(F.least("low", limit), F.lit(0.0)))
    paired = pairs.join(known, "video_id", "left").select("video_id", "range_no", start.alias("start_sec"), F.least(end, limit).alias("end_sec")).where("end_sec > start_sec")
    none = known.join(markers.select("video_id").distinct(), "video_id", "left_anti")
    default = none.select("video_id", F.lit(0).cast("long").alias("range_no"), F.lit(0.0).alias("start_sec"), F.least(F.lit(DEFAULT_CLIP_SEC), "duration_sec").alias("end_sec"))
    return paired.unionByName(default)


def clip_to_first(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """Clips each segment to the first range, in list order, that it overlaps; others go. Videos
    without ranges keep their segments as they are."""
    bare = segments.select(*TIMES)
    hit = bucketed_overlaps(bare, ranges)
    first = hit.groupBy("video_id", "seg_no").agg(F.min_by(F.struct("start_sec", "end_sec", "from_sec", "to_sec"), F.col("range_no")).alias("x"))
    clipped = first.select("video_id", "seg_no", "x.*")
    whole = bare.join(ranges.select("video_id").distinct(), "video_id", "left_anti").distinct()
    kept = with_texts(clipped.unionByName(whole, allowMissingColumns=True), segments)
    return kept.select("video_id", "seg_no", F.greatest("start_sec", "from_sec").alias("start_sec"), F.least("end_sec", "to_sec").alias("end_sec"), "text")


def with_texts(found: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows that were found without texts (TIMES and more), with the texts of their segments, which move once."""
    s = segments.select(*[F.col(c).alias(f"_{c}") for c in TIMES], "text")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in TIMES]
    return found.join(s, same).drop(*[f"_{c}" for c in TIMES])


def within_padding(segments: DataFrame, ranges: DataFrame, padding_sec: float = 60.0) -> DataFrame:
    """Segments that overlap a range widened on both sides (its start not below 0); a semi join."""
    r = ranges.select("video_id", F.greatest(F.col("start_sec") - padding_sec, F.lit(0.0)).alias("start_sec"), (F.col("end_sec") + padding_sec).alias("end_sec"))
    s = segments.select(*TIMES).withColumn("bucket", touched("start_sec", "end_sec")).alias("s")
    r = cover(r.withColumn("bucket", touched("start_sec", "end_sec"))).alias("r")
    near = [F.col(f"s.{k}") == F.col(f"r.{k}") for k in ("video_id", "bucket")]
    hit = s.join(r, [*near, overlaps("s.start_sec", "s.end_sec", "r.start_sec", "r.end_sec")], "left_semi").select("video_id", "seg_no")
    return segments.join(hit, ["video_id", "seg_no"], "left_semi")


def cover(ranges: DataFrame) -> DataFrame:
    """Ranges that overlap as one each, within a video and bucket (a stretch of time): what decides whether
    something in the bucket overlaps any. Empty and inverted ones stay as they are."""
    place = W.partitionBy("video_id", "bucket", F.col("end_sec") > F.col("start_sec")).orderBy("start_sec", "end_sec")
    reach = F.max("end_sec").over(place.rowsBetween(W.unboundedPreceding, -1))
    apart = reach.isNull() | (F.col("start_sec") >= reach) | (F.col("end_sec") <= F.col("start_sec"))
    group = F.sum("apart").over(place.rowsBetween(W.unboundedPreceding, 0))
    grouped = ranges.withColumn("valid", F.col("end_sec") > F.col("start_sec")).withColumn("apart", apart.cast("int")).withColumn("group", group)
    return grouped.groupBy("video_id", "bucket", "valid", "group").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec")).drop("valid", "group")


def coalesced(ranges: DataFrame, padding_sec: float = 0.0) -> DataFrame:
    """Widens ranges, sorts them and merges those that overlap or touch; inverted and empty ones go
    first. Numbers count from 0 in order of time."""
    p = ranges.where("end_sec > start_sec").select("video_id", F.greatest(F.col("start_sec") - padding_sec, F.lit(0.0)).alias("start_sec"), (F.col("end_sec") + padding_sec).alias("end_sec"))
    return merged(p)


def merged(ranges: DataFrame, touching: bool = True) -> DataFrame:
    """Ranges that overlap, or also those that touch, as one each: a sweep that carries the furthest end. Numbers count
    from 0 in order of time."""
    order, stretch = ["start_sec", "end_sec"], timed("start_sec", STRETCH_SEC)
    p = running(ranges, ["video_id"], order, stretch, {"reach": Fold("max", F.col("end_sec"), own=False)})
    apart = F.col("start_sec") > F.col("reach") if touching else F.col("start_sec") >= F.col("reach")
    p = running(p, ["video_id"], order, stretch, {"range_no": Fold("sum", F.when(F.col("reach").isNull() | apart, 1).otherwise(0))}).withColumn("range_no", F.col("range_no") - 1)
    return p.groupBy("video_id", "range_no").agg(F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"))


def compacted(ranges: DataFrame) -> DataFrame:
    """Adds new_start_sec and new_end_sec: the ranges laid end to end in list order from 0."""
    length = F.greatest(F.col("end_sec") - F.col("start_sec"), F.lit(0.0))
    laid = running(ranges, ["video_id"], ["range_no"], dense("range_no"), {"new_end_sec": Fold("sum", length)})
    return laid.withColumn("new_start_sec", F.col("new_end_sec") - length)


def numbered(segments: DataFrame, outer: str = "range_no", inner: str = "seg_no") -> DataFrame:
    """Adds ``nth``: the number of a segment in its video, counted by ``outer``, then by ``inner``."""
    stretch = F.col(outer).cast("long") * F.lit(1 << 40) + dense(inner)
    return running(segments, ["video_id"], [outer, inner], stretch, {"nth": Fold("count", F.lit(1), own=False)})


def remapped(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """Clips each segment to every range that it overlaps and moves it to the compacted timeline.
    Overlapping ranges give a segment more than once. seg_no counts by range, then by segment."""
    hit = bucketed_overlaps(segments.select(*TIMES), compacted(ranges.where("end_sec > start_sec")))
    shift = F.col("new_start_sec") - F.col("from_sec")
    return with_texts(numbered(hit), segments).select("video_id", F.col("nth").alias("seg_no"), (F.greatest("start_sec", "from_sec") + shift).alias("start_sec"), (F.least("end_sec", "to_sec") + shift).alias("end_sec"), "text")


def shifted(local: DataFrame, ranges: DataFrame) -> DataFrame:
    """Moves segments with times within a range (video_id, range_no, ...) to times of the video;
    numbers them by range, then by segment."""
    r = ranges.select("video_id", "range_no", F.col("start_sec").alias("offset_sec"))
    return numbered(local.join(r, ["video_id", "range_no"])).select("video_id", F.col("nth").alias("seg_no"), (F.col("start_sec") + F.col("offset_sec")).alias("start_sec"), (F.col("end_sec") + F.col("offset_sec")).alias("end_sec"), "text")


def chunk_segments(chunks: DataFrame) -> DataFrame:
    """Segments of chunks (video_id, chunk_no, chunk_start_sec, t0, t1, text) whose times are in
    units of 10 ms from the chunk's start; blank texts go."""
    from reelspan.functions.text import trimmed

    number = F.row_number().over(W.partitionBy("video_id").orderBy("chunk_no", "t0", "t1")) - 1
    return chunks.where(trimmed("text") != "").select("video_id", number.cast("long").alias("seg_no"), (F.col("chunk_start_sec") + F.col("t0") * 0.01).alias("start_sec"), (F.col("chunk_start_sec") + F.col("t1") * 0.01).alias("end_sec"), trimmed("text").alias("text"))


def without_range(markers: DataFrame, doomed: DataFrame) -> DataFrame:
    """Markers without the pair of each range in ``doomed`` (video_id, range_no): the marker of each
    rank is matched within SAME_MARKER_SEC and one row of each match goes."""
    order = W.partitionBy("video_id").orderBy("marker_sec", "marker_id")
    ranked = markers.withColumn("nth", F.row_number().over(order) - 1)
    wanted = ranked.withColumn("range_no", F.floor(F.col("nth") / 2).cast("long")).join(doomed.select("video_id", "range_no").distinct(), ["video_id", "range_no"]).select("video_id", F.col("marker_sec").alias("gone_sec"), F.col("nth").alias("gone"))
    near = joined_nearby(ranked, "marker_sec", wanted, "gone_sec", SAME_MARKER_SEC).where(F.abs(F.col("marker_sec") - F.col("gone_sec")) < SAME_MARKER_SEC)
    first = near.withColumn("k", F.row_number().over(W.partitionBy("video_id", "gone").orderBy(F.abs(F.col("nth") - F.col("gone")), "nth"))).where("k = 1")
    return markers.join(first.select("video_id", "marker_id"), ["video_id", "marker_id"], "left_anti")


def markers_of(ranges: DataFrame) -> DataFrame:
    """Two markers for each range."""
    return ranges.select("video_id", F.explode(F.array("start_sec", "end_sec")).alias("marker_sec"))


def range_at(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """For each point (video_id, point_id, point_sec) the first range that holds it, both ends
    included; where none does, DEFAULT_CLIP_SEC from the point on with a null number."""
    stretch = lambda c: F.floor(F.col(c) / STRETCH_SEC)
    r = ranges.where("end_sec >= start_sec").select("video_id", "range_no", "start_sec", "end_sec", F.explode(F.sequence(stretch("start_sec"), stretch("end_sec"))).alias("stretch")).alias("r")
    p = points.select("video_id", "point_id", "point_sec", stretch("point_sec").alias("stretch")).alias("p")
    on = (F.col("p.video_id") == F.col("r.video_id")) & (F.col("p.stretch") == F.col("r.stretch")) & F.col("p.point_sec").between(F.col("r.start_sec"), F.col("r.end_sec"))
    hit = p.join(r, on, "left").select("p.video_id", "p.point_id", "p.point_sec", "r.range_no", "r.start_sec", "r.end_sec")
    first = hit.withColumn("k", F.row_number().over(W.partitionBy("video_id", "point_id").orderBy("range_no"))).where("k = 1")
    return first.select("video_id", "point_id", "point_sec", "range_no", F.coalesce("start_sec", "point_sec").alias("start_sec"), F.coalesce("end_sec", F.col("point_sec") + DEFAULT_CLIP_SEC).alias("end_sec"))


def nearest_marker(points: DataFrame, markers: DataFrame, tolerance: float) -> DataFrame:
    """For each point (video_id, point_id, point_sec) the nearest marker within ``tolerance``; of
    equally near ones the later. Points without one have no row; repeated points have each their own. An as-of join: points and markers
    are sorted as one, and the marker before and the one after are carried along, so dense markers cost no more than their number."""
    at = lambda sec: timed(sec, STRETCH_SEC)
    last = markers.groupBy("video_id", F.col("marker_sec").alias("at_sec")).agg(F.max("marker_id").alias("marker_id"))
    rows = last.select("video_id", "at_sec", F.lit(0).alias("kind"), F.lit(None).cast(points.schema["point_id"].dataType).alias("point_id"), F.struct(F.col("at_sec").alias("sec"), F.col("marker_id").alias("id")).alias("marker"))
    rows = rows.unionByName(points.select("video_id", F.col("point_sec").alias("at_sec"), F.lit(1).alias("kind"), "point_id"), allowMissingColumns=True)  # markers before points of one time
    both = running(rows, ["video_id"], ["at_sec", "kind"], at("at_sec"), {"before": Fold("last", F.col("marker")), "after": Fold("last", F.col("marker"), backward=True)}).where("kind = 1")
    away = lambda m: F.abs(F.col(m)["sec"] - F.col("at_sec"))
    near = F.when(F.col("before").isNull() | (away("after") <= away("before")), F.col("after")).otherwise(F.col("before"))
    found = both.withColumn("near", near).withColumn("distance_sec", away("near")).where(F.col("distance_sec") <= tolerance)
    return found.select("video_id", "point_id", F.col("near.sec").alias("marker_sec"), F.col("near.id").alias("marker_id"), "distance_sec")


def with_settings(paths: DataFrame, settings: DataFrame) -> DataFrame:
    """Every pending path with the one reviewed row of settings, which is broadcast. One row is reviewed;
    of a table with more any one is taken and the others are dropped."""
    return paths.crossJoin(F.broadcast(settings.limit(1)))


def looked_up(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """For (request_id, whole_key, range_key) the cached value of the whole file, else that of the
    ranges, and where it came from; ``cache`` has key and value, an empty value counts as none."""
    c = cache.where("value <> ''")
    whole = c.select(F.col("key").alias("whole_key"), F.col("value").alias("whole"))
    part = c.select(F.col("key").alias("range_key"), F.col("value").alias("part"))
    source = F.when(F.col("whole").isNotNull(), "file").when(F.col("part").isNotNull(), "ranges").otherwise("compute")
    return keys.join(whole, "whole_key", "left").join(part, "range_key", "left").select("request_id", F.coalesce("whole", "part").alias("value"), source.alias("source"))


def usable(ranges: DataFrame, overall: DataFrame) -> DataFrame:
    """Ranges with end after start; a video of which none survives has its overall range (video_id,
    range_start_sec, range_end_sec) instead, where that is valid."""
    good = ranges.where("end_sec > start_sec")
    rest = overall.where("range_end_sec > range_start_sec").join(good.select("video_id").distinct(), "video_id", "left_anti")
    return good.unionByName(as_range(rest))


def projected(ranges: DataFrame, overall: DataFrame) -> DataFrame:
    """As ``usable``, but the overall range steps in only for a video without any range."""
    rest = overall.join(ranges.select("video_id").distinct(), "video_id", "left_anti")
    return ranges.unionByName(as_range(rest)).where("end_sec > start_sec")


def finite(ranges: DataFrame, overall: DataFrame) -> DataFrame:
    """As ``projected``, without ranges that are not finite, and with the start not below 0."""
    rest = overall.join(ranges.select("video_id").distinct(), "video_id", "left_anti")
    both = ranges.unionByName(as_range(rest))
    ok = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    clamped = both.where(ok("start_sec") & ok("end_sec")).withColumn("start_sec", F.greatest("start_sec", F.lit(0.0)))
    return clamped.withColumn("end_sec", F.greatest("end_sec", "start_sec")).where("end_sec > start_sec")


def decodable(ranges: DataFrame) -> DataFrame:
    """Ranges as they are decoded: start not below 0, empty ones gone. No row means the whole file."""
    return ranges.withColumn("start_sec", F.greatest("start_sec", F.lit(0.0))).where("end_sec > start_sec")


def as_range(overall: DataFrame) -> DataFrame:
    """An overall range as range 0."""
    return overall.select("video_id", F.lit(0).cast("long").alias("range_no"), F.col("range_start_sec").alias("start_sec"), F.col("range_end_sec").alias("end_sec"))


def positions(markers: DataFrame, durations: DataFrame) -> DataFrame:
    """Finite markers, clamped to the duration where it is known."""
    ok = ~F.isnan("marker_sec") & (F.abs(F.col("marker_sec")) < float("inf"))
    d = durations.where("duration_sec > 0").select("video_id", "duration_sec")
    sec = F.least(F.greatest("marker_sec", F.lit(0.0)), F.coalesce("duration_sec", F.lit(float("inf"))))
    return markers.where(ok).join(d, "video_id", "left").select("video_id", sec.alias("marker_sec"), "marker_id")


def joined_nearby(left: DataFrame, at: str, right: DataFrame, to: str, tolerance: float) -> DataFrame:
    """Pairs of a video whose times may be within ``tolerance`` (and some that are not): each row of
    ``left`` meets the stretch of that length it lies in and both neighbours."""
    width = max(tolerance, 1e-9) * 1.001
    near = right.withColumn("stretch", F.explode(F.array(*[F.floor(F.col(to) / width) + k for k in (-1, 0, 1)])))
    return left.withColumn("stretch", F.floor(F.col(at) / width)).join(near, ["video_id", "stretch"]).drop("stretch")


def touched(a: str, b: str, bucket_sec: float = STRETCH_SEC) -> Column:
    """A row for each stretch of time from one time to another."""
    return F.explode(F.sequence(F.floor(F.least(a, b) / bucket_sec), F.floor(F.greatest(a, b) / bucket_sec)))


def bucketed_overlaps(segments: DataFrame, ranges: DataFrame, bucket_sec: float = STRETCH_SEC) -> DataFrame:
    """All pairs of a segment and a range that overlap, with the range's columns, its times as from_sec
    and to_sec; joined by (video, stretch of time). A pair that shares several stretches comes out of
    the first one only. What is empty or inverted overlaps as its ends say. Times are finite, and ranges
    are no longer than their videos, as markers are clamped: each stretch that one touches is a row."""
    s = segments.withColumn("bucket", touched("start_sec", "end_sec", bucket_sec))
    r = ranges.withColumnsRenamed({"start_sec": "from_sec", "end_sec": "to_sec"}).withColumn("bucket", touched("from_sec", "to_sec", bucket_sec))
    low = lambda a, b: F.floor(F.least(a, b) / bucket_sec)
    first = F.greatest(low("start_sec", "end_sec"), low("from_sec", "to_sec"))
    return s.join(r, ["video_id", "bucket"]).where(overlaps("start_sec", "end_sec", "from_sec", "to_sec") & (F.col("bucket") == first)).drop("bucket")
