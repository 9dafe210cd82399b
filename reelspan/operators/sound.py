"""Sound in pieces: a stream is rows (stream_id, piece_no, first_sample, samples) that follow each other.

Pieces need not be equally long, but leave no gap. What an operation needs beyond a piece is one sample of the next
piece and the length of the stream; both are joined by (stream, piece), so a stream of any length is as many
tasks' work as it has pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions.text import col
from reelspan.operators.aggregates import AUDIBLE_BYTES, AUDIBLE_PEAK, AUDIBLE_RMS, SAMPLE_RATE
from reelspan.operators.scan import Fold, dense, running

#: Pieces of a stream that share one row of its length.
GROUP = 1024


def pieces_of(pcm: DataFrame, size: int) -> DataFrame:
    """Pieces of ``size`` samples of whole streams (stream_id, samples); empty and null ones have none."""
    count = F.ceil(F.size("samples") / size).cast("int")
    numbered = pcm.where("size(samples) > 0").select("stream_id", "samples", F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
    return numbered.select("stream_id", F.col("k").cast("long").alias("piece_no"), (F.col("k").cast("long") * size).alias("first_sample"), F.slice("samples", F.col("k") * size + 1, F.lit(size)).alias("samples"))


def placed(parts: DataFrame) -> DataFrame:
    """Pieces of parts (stream_id, piece_no, samples) in order of their numbers, which are dense: adds where each begins."""
    laid = running(parts, ["stream_id"], ["piece_no"], dense("piece_no", GROUP), {"first_sample": Fold("sum", F.size("samples").cast("long"), own=False)})
    return laid.select("stream_id", "piece_no", F.coalesce("first_sample", F.lit(0).cast("long")).alias("first_sample"), "samples")


def lengths(pieces: DataFrame) -> DataFrame:
    """(stream_id, n_samples, n_pieces)."""
    return pieces.groupBy("stream_id").agg(F.sum(F.size("samples")).cast("long").alias("n_samples"), F.max("piece_no").alias("last_piece"))


def with_length(pieces: DataFrame) -> DataFrame:
    """Adds the length of each piece's stream, one row of which serves GROUP pieces."""
    spread = lengths(pieces).select("stream_id", "n_samples", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last_piece") / GROUP).cast("long"))).alias("_group"))
    return pieces.withColumn("_group", F.floor(F.col("piece_no") / GROUP).cast("long")).join(spread, ["stream_id", "_group"]).drop("_group")


def with_halo(pieces: DataFrame) -> DataFrame:
    """Adds ``after``: the first sample of the next piece, null behind the last one."""
    heads = pieces.select("stream_id", (F.col("piece_no") - 1).alias("piece_no"), F.get("samples", F.lit(0)).alias("after"))
    return pieces.join(heads, ["stream_id", "piece_no"], "left")


def resampled_pieces(pieces: DataFrame, from_rate: int, to_rate: int) -> DataFrame:
    """Linear resampling as ``aggregates.resampled`` does it, bit for bit, piece by piece: each piece makes the
    samples whose left neighbour it holds. Pieces that make none go; the numbers of the others stay dense only for equal
    rates, so ``recut`` them where that matters."""
    if from_rate == to_rate:
        return pieces.select("stream_id", "piece_no", "first_sample", "samples")
    ratio = from_rate / to_rate
    wide = with_length(with_halo(pieces)).withColumnsRenamed({"first_sample": "_first", "samples": "_samples"})  # no name is read and made in one select
    n, first, own = F.col("n_samples"), F.col("_first"), F.size("_samples")
    count = F.greatest(F.lit(1), F.floor(n / F.lit(ratio)).cast("long"))
    low_of = lambda i: F.least(F.floor(i * F.lit(ratio)).cast("long"), n - 1)
    near = F.sequence(F.greatest(F.floor(first / F.lit(ratio)).cast("long") - 1, F.lit(0)), F.ceil((first + own) / F.lit(ratio)).cast("long") + 1)
    mine = F.filter(near, lambda i: (i < count) & (low_of(i) >= first) & (low_of(i) < first + own))

    def at(i: Column) -> Column:
        low = low_of(i)
        here = (low - first).cast("int")
        a = F.get("_samples", here)
        b = F.when(low + 1 > n - 1, a).when(here + 1 < own, F.get("_samples", here + 1)).otherwise(F.col("after"))
        part = (i * F.lit(ratio) - low).cast("float")
        return (a + ((b - a).cast("float") * part).cast("float")).cast("float")

    made = wide.withColumn("_mine", mine).where("size(_mine) > 0")
    return made.select("stream_id", "piece_no", F.get("_mine", F.lit(0)).alias("first_sample"), F.transform("_mine", at).alias("samples"))


def recut(pieces: DataFrame, size: int) -> DataFrame:
    """The same streams in pieces of ``size`` samples, the last one shorter, numbered from 0."""
    first, end = F.col("first_sample"), F.col("first_sample") + F.size("samples")
    target = F.explode(F.sequence(F.floor(first / size).cast("long"), F.floor((end - 1) / size).cast("long"))).alias("k")
    cut = pieces.where("size(samples) > 0").select("stream_id", "first_sample", "samples", target)
    start = F.greatest(F.col("k") * size, first)
    stop = F.least((F.col("k") + 1) * size, F.col("first_sample") + F.size("samples"))
    parts = cut.select("stream_id", "k", F.struct(start.alias("at"), F.slice("samples", (start - first + 1).cast("int"), (stop - start).cast("int")).alias("s")).alias("part"))
    joined = parts.groupBy("stream_id", "k").agg(F.array_sort(F.collect_list("part")).alias("parts"))  # at most ``size`` samples
    return joined.select("stream_id", F.col("k").alias("piece_no"), (F.col("k") * size).alias("first_sample"), F.flatten(F.transform("parts", lambda p: p["s"])).alias("samples"))


def stretch(pieces: DataFrame, start_sec: Column | str, length_sec: Column | str, rate: int = SAMPLE_RATE) -> DataFrame:
    """The part of each stream from ``start_sec`` on, ``length_sec`` long, as far as there are samples, none before
    the beginning: pieces whose ``first_sample`` counts from the start of the stretch. The bounds may differ by stream."""
    low = F.greatest(F.floor(col(start_sec) * rate), F.lit(0)).cast("long")
    count = F.greatest(F.floor(col(length_sec) * rate), F.lit(0)).cast("long")
    bounded = pieces.withColumns({"_low": low, "_high": low + count}).withColumnRenamed("first_sample", "_first")
    start = F.greatest("_first", "_low")
    stop = F.least(F.col("_first") + F.size("samples"), F.col("_high"))
    hit = bounded.withColumns({"_start": start, "_stop": stop}).where("_stop > _start")
    return hit.select("stream_id", "piece_no", (F.col("_start") - F.col("_low")).alias("first_sample"), F.slice("samples", (F.col("_start") - F.col("_first") + 1).cast("int"), (F.col("_stop") - F.col("_start")).cast("int")).alias("samples"))


def levels(pieces: DataFrame, most_samples: int = AUDIBLE_BYTES // 4) -> DataFrame:
    """Per stream: samples looked at (the first 8 MiB), peak, rms and whether there is sound. Samples that are not finite
    are skipped but count in the mean. Squares are added piece by piece, so the last bits of the mean may differ from a whole array's."""
    head = pieces.where(F.col("first_sample") < most_samples).withColumn("samples", F.slice("samples", F.lit(1), F.least(F.size("samples"), most_samples - F.col("first_sample")).cast("int")))
    fine = F.transform(F.filter("samples", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))), lambda x: x.cast("double"))
    each = head.select("stream_id", F.size("samples").cast("long").alias("n"), F.aggregate(fine, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))).alias("p"), F.aggregate(fine, F.lit(0.0), lambda a, x: a + x * x).alias("s"))
    out = each.groupBy("stream_id").agg(F.sum("n").alias("n_samples"), F.max("p").alias("peak"), F.sqrt(F.sum("s") / F.sum("n")).alias("rms"))
    return out.withColumn("audible", (F.col("peak") > AUDIBLE_PEAK) | (F.col("rms") > AUDIBLE_RMS))
