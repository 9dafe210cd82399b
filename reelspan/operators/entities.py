"""Names that a transcript keeps coming back to.

Counting is plain Spark: phrases are extracted from each segment and summed by video and name, so
only distinct names of a video are brought together. What is left is a fold over that short list,
in which merged names feed further merges; it runs in Arrow batches over one row per video.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions.text import contains_any, let, simplified, trimmed

#: Words that open no name, and words that are no part of one before it.
IGNORED = ("The", "This", "That", "Then", "And", "But", "So", "If", "When", "For", "Week", "German", "Japanese", "Brazilian", "Brazil", "UTC")
IGNORED_PREFIXES = ("and", "but", "the", "this", "that", "then", "when", "with", "from", "through", "using", "like", "about", "after", "before", "into", "only", "also", "real", "first", "second", "third", "week", "what", "where", "which", "while", "because", "there", "their", "your", "some", "many", "very", "just", "kind", "sort", "will", "would", "could", "should", "have", "been", "were", "they", "them", "than", "how", "why", "who", "whom", "whose")
PRONOUN_PHRASES = ("the way she", "the way he", "the way they", "she teaches", "he teaches", "they teach", "this method", "that approach", "the way it works")
UNLOCK_PHRASES = ("unlock", "key clicks", "one key", "one logic", "core logic")
METHOD_PHRASES = ("method", "approach", "framework", "style", "language-learning", "the way", "teaches", "teach")
#: Two to four capitalised words; the character before is matched instead of a word boundary, whose
#: meaning differs between engines.
PHRASE = r"[A-Z][\p{L}0-9]*(?:\s+[A-Z][\p{L}0-9]*){1,3}"
NAME = rf"(?:^|[^\p{{L}}\p{{N}}_])({PHRASE})"
PREFIXED = rf"(?:^|[^\p{{L}}\p{{N}}_])([a-z][\p{{L}}0-9]{{2,}}\s+{PHRASE})"
#: What every phrase holds.
TWO_CAPITALS = r"[A-Z][\p{L}0-9]*\s+[A-Z]"
#: Words of a merged name, and names of a video, at most.
MOST_WORDS, MOST_NAMES = 6, 6


def name_counts(segments: DataFrame) -> DataFrame:
    """(video_id, name, n): one for each capitalised phrase, two for each that follows a lower-case
    word of three letters or more, which then leads the name, capitalised."""
    text = segments.select("video_id", trimmed("text").alias("text")).where(F.regexp_like("text", F.lit(TWO_CAPITALS)))
    raw = lambda pattern, weight: F.transform(F.regexp_extract_all("text", F.lit(pattern), 1), lambda x: F.struct(F.lit(weight).alias("weight"), simplified(x).alias("name")))
    found = text.select("video_id", F.explode(F.concat(raw(NAME, 1), raw(PREFIXED, 2))).alias("x")).select("video_id", "x.*").withColumn("w", F.split("name", " "))
    low = F.lower(F.col("w")[0])
    lead = F.concat(F.upper(F.left(low, F.lit(1))), F.substring(low, 2, 2**30))
    good = F.when(F.col("weight") == 1, ~F.col("w")[0].isin(*IGNORED)).otherwise(~low.isin(*IGNORED_PREFIXES) & ~F.col("w")[1].isin(*IGNORED))
    name = F.when(F.col("weight") == 1, F.col("name")).otherwise(F.concat_ws(" ", lead, F.array_join(F.slice("w", 2, 9), " ")))
    return found.where(good).select("video_id", name.alias("name"), "weight").groupBy("video_id", "name").agg(F.sum("weight").alias("n"))


def merged(a: list[str], b: list[str]) -> list[str]:
    """Two names joined on their longest overlap of end and beginning, ignoring case; of equally
    long overlaps the one that keeps ``a`` in front. Empty without an overlap."""
    la, lb = [w.lower() for w in a], [w.lower() for w in b]
    for n in range(min(len(a), len(b)), 0, -1):
        for (x, lx), (y, ly) in (((a, la), (b, lb)), ((b, lb), (a, la))):
            if lx[-n:] == ly[:n]:
                return x + y[n:]
    return []


def grown(counts: dict[str, int]) -> dict[str, int]:
    """Adds merged names, as long as they are longer than both parts and have at most MOST_WORDS
    words, with the sum of their counts, until nothing changes.

    A name can only be merged with one that holds its last word, or whose last word it holds, so names
    meet by an index of their words. A merged name is longer than its parts, so its count is settled
    when those of all shorter names are: each length is looked at once, in whatever order."""
    counts, length = dict(counts), {n: len(n.split()) for n in counts}
    holds: dict[str, set[str]] = defaultdict(set)
    ends: dict[str, set[str]] = defaultdict(set)
    for size in range(1, MOST_WORDS):
        fresh = sorted(n for n in counts if length[n] == size)
        for name in fresh:
            parts = name.lower().split()
            ends[parts[-1]].add(name)
            for word in parts:
                holds[word].add(name)
        for name in fresh:  # with all that are no longer
            parts = name.lower().split()
            for other in sorted(holds[parts[-1]].union(*(ends[w] for w in parts))):
                if other == name or length[other] == size and other > name:
                    continue
                a, b = sorted((name, other))
                both = merged(a.split(), b.split())
                if max(length[a], length[b]) < len(both) <= MOST_WORDS:
                    new, n = " ".join(both), counts[a] + counts[b]
                    if counts.get(new, 0) < n:
                        counts[new], length[new] = n, len(both)
    return counts


def ranked(counts: dict[str, int]) -> list[tuple[str, int]]:
    """Names by words, characters and count, all descending, then in binary order; a name that holds
    or is held in a better one, ignoring case, goes; MOST_NAMES stay."""
    out: list[tuple[str, int]] = []
    for name, n in sorted(counts.items(), key=lambda x: (-len(x[0].split()), -len(x[0]), -x[1], x[0])):
        low = name.lower()
        if not any(low in kept.lower() or kept.lower() in low for kept, _ in out):
            out.append((name, n))
    return out[:MOST_NAMES]


def top_names(segments: DataFrame) -> DataFrame:
    """(video_id, rank, name, n) of each video's names, the best of rank 1."""
    lists = name_counts(segments).groupBy("video_id").agg(F.collect_list("name").alias("names"), F.collect_list("n").alias("ns"))

    def run(batches):
        for batch in batches:
            rows = [(video, k + 1, name, n) for video, names, ns in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, (name, n) in enumerate(ranked(grown(dict(zip(names, ns, strict=True)))))]
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["video_id", "rank", "name", "n"])

    return lists.mapInArrow(run, "video_id long, rank long, name string, n long")


def names_of(segments: DataFrame) -> DataFrame:
    """(video_id, names), best first, of the videos that have names."""
    return top_names(segments).groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("names"))


def depends(names: Column | str, text: Column) -> Column:
    """(pronoun_dependent, unlock_method) of a transcript's whole text, which is looked at only where there are names."""

    def flags(low: Column) -> Column:
        has = lambda phrases: contains_any(low, phrases, lowered=True)
        return F.struct(has(PRONOUN_PHRASES).alias("pronoun_dependent"), (has(UNLOCK_PHRASES) & has(METHOD_PHRASES)).alias("unlock_method"))

    none = F.struct(F.lit(False).alias("pronoun_dependent"), F.lit(False).alias("unlock_method"))
    n = F.col(names) if isinstance(names, str) else names
    return F.when(F.coalesce(F.size(n), F.lit(0)) > 0, let(F.lower(text), flags)).otherwise(none)


def reference_facts(segments: DataFrame) -> DataFrame:
    """Per video: names (best first), text (all segments), pronoun_dependent (it has names and speaks
    of them by pronouns) and unlock_method (it has names and speaks of an unlocking method)."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("seg_no", trimmed("text").alias("t")))), lambda x: x["t"])
    text = segments.where(trimmed("text") != "").groupBy("video_id").agg(F.array_join(pieces, " ").alias("text"))
    both = text.join(names_of(segments), "video_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>"))).withColumn("flags", depends("names", F.col("text")))
    return both.select("video_id", "text", "names", "flags.*")


def names_text(names: Column | str) -> Column:
    """Names joined, or the sentence that there are none."""
    c = F.col(names) if isinstance(names, str) else names
    return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.array_join(c, ", ")).otherwise("No strong named reference detected in the selected range.")


def mentions_a_name(prompt: Column | str, names: Column | str) -> Column:
    """Whether a prompt holds any name in full, or its first two words, ignoring case."""
    n = F.col(names) if isinstance(names, str) else names
    return let(F.lower(F.col(prompt) if isinstance(prompt, str) else prompt), lambda p: F.exists(n, lambda x: F.contains(p, F.lower(x)) | F.contains(p, F.lower(F.substring_index(x, " ", 2)))))
