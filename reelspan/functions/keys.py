"""Content-addressed keys, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelspan.functions.text import col, decimals, language, time_token, trimmed


def digest(c: Column, length: int) -> Column:
    """The first hex digits of SHA-256."""
    return F.left(F.sha2(c, 256), F.lit(length))


def file_identity(path: Column | str, size: Column | str, modified: Column | str) -> Column:
    """24 hex digits of path, size and modification time (UTC, milliseconds); a missing file has
    size 0 and an empty time."""
    ntz = F.to_timestamp_ntz(col(modified).cast("string"))
    when = F.concat(F.date_format(ntz, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    return digest(F.concat_ws("\n", col(path), F.coalesce(col(size), F.lit(0)).cast("string"), F.coalesce(when, F.lit(""))), 24)


def language_key(c: Column | str) -> Column:
    """A language as a part of a key."""
    key = F.regexp_replace(language(c, others=True), "[^a-z0-9_-]", "_")
    return F.when(key == "", "auto").otherwise(key)


def transcript_key(identity: Column | str, lang: Column | str) -> Column:
    """The key of a whole file's transcript."""
    return F.concat_ws(".", F.lit("video_transcript"), col(identity), language_key(lang))


def ranges_identity(ranges: Column | str) -> Column:
    """24 hex digits of the valid ranges, in their order."""
    good = F.filter(col(ranges), lambda r: r["end_sec"] > r["start_sec"])
    return digest(F.array_join(F.transform(good, lambda r: F.concat(decimals(F.greatest(r["start_sec"], F.lit(0.0)), 3), F.lit("_"), decimals(r["end_sec"], 3))), "|"), 24)


def range_transcript_key(identity: Column | str, lang: Column | str, ranges: Column | str) -> Column:
    """The key of a transcript of ranges."""
    return F.concat_ws(".", F.lit("video_transcript_range"), col(identity), language_key(lang), ranges_identity(ranges))


def prompt_video_key(path: Column | str) -> Column:
    """The prompt key of a video, by file name alone."""
    return F.concat(F.lit("gpt_prompt."), digest(F.element_at(F.split(col(path), "/"), -1), 24))


def prompt_input_key(model: Column | str, text: Column | str, separator: str = "\n") -> Column:
    """The prompt key of a model and its input, with what parts them in the hashed bytes; a cache
    that others filled is read with their separator."""
    return F.concat(F.lit("gpt_prompt_input.v15."), digest(F.concat(F.lower(trimmed(model)), F.lit(separator), trimmed(text)), 32))


def pending_key(video_key: Column | str) -> Column:
    """The key that says a prompt is pending."""
    return F.concat(F.lit("gpt_prompt_pending."), F.substring_index(col(video_key), ".", -1))


def name_token(path: Column | str) -> Column:
    """The file name in URL-safe base64 without padding or line breaks."""
    name = F.element_at(F.split(col(path), "/"), -1)
    return F.translate(F.base64(name.cast("binary")), "+/=\r\n", "-_")


def markers_key(path: Column | str) -> Column:
    """The key of a video's markers."""
    return F.concat(F.lit("video_markers."), name_token(path))


def review_key_of_markers(path: Column | str, markers: Column | str) -> Column:
    """The review key by markers: sorted milliseconds."""
    ms = F.transform(F.array_sort(col(markers)), lambda m: time_token(m).cast("string"))
    token = F.when(F.size(col(markers)) > 0, F.array_join(ms, "_")).otherwise("no_markers")
    return F.concat_ws(".", F.lit("review.settings"), name_token(path), token)


def review_key_of_ranges(path: Column | str, ranges: Column | str) -> Column:
    """The review key by ranges: start and end milliseconds. It differs from the key by markers of
    the same ranges, so settings saved by one are not found by the other."""
    ms = F.transform(col(ranges), lambda r: F.concat(time_token(r["start_sec"]).cast("string"), F.lit("-"), time_token(r["end_sec"]).cast("string")))
    token = F.when(F.size(col(ranges)) > 0, F.array_join(ms, "_")).otherwise("no_markers")
    return F.concat_ws(".", F.lit("review.settings"), name_token(path), token)


def template_key(lang: Column | str) -> Column:
    """The key of an input template by language."""
    return F.concat(F.lit("gpt.input_text_template.v33."), language(lang, others=False))
