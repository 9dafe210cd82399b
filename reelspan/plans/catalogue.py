"""The registered queries of the transcript library and the SQL that they are held against.

Each query is a function of (spark, sf_dir); its SQL, where there is one, runs on DuckDB over the
same tables. Both give the same columns with explicit types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.functions import keys as K
from reelspan.functions import text
from reelspan.operators import aggregates as A
from reelspan.operators import entities as E
from reelspan.operators import intervals as I
from reelspan.operators import lines as L
from reelspan.operators import timeline as T
from reelspan.plans import prompts as P
from reelspan.sources import derived, files, store
from reelspan.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Shared pieces of the SQL side.
SEGMENTS = r"""
lines AS (SELECT doc_id AS video_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seg_no FROM documents),
filled AS (SELECT video_id, seg_no, regexp_replace(line, '^\s+|\s+$', '', 'g') AS text FROM lines),
counted AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 0.5::DOUBLE AS secs FROM filled WHERE text <> ''),
segments AS (SELECT video_id, seg_no, sum(secs) OVER w - secs AS start_sec, sum(secs) OVER w AS end_sec, text FROM counted WINDOW w AS (PARTITION BY video_id ORDER BY seg_no)),
durations AS (SELECT video_id, max(end_sec) AS duration_sec FROM segments GROUP BY video_id)"""
MARKERS = """
markers AS (SELECT user_id::BIGINT AS video_id, (epoch_us(ts::TIMESTAMP) % 600000000) / 1e6::DOUBLE AS marker_sec, event_id::BIGINT AS marker_id FROM events WHERE event_type = 'click')"""
RANGES = """
pairs AS (SELECT video_id, (n - 1) // 2 AS range_no, min(marker_sec) AS low, max(marker_sec) AS high, count(*) AS n
          FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY marker_sec, marker_id) AS n FROM markers) GROUP BY 1, 2),
ranges AS (SELECT * FROM (SELECT p.video_id, range_no, CASE WHEN duration_sec IS NULL THEN low ELSE least(low, duration_sec) END AS start_sec,
                  least(CASE WHEN n = 2 THEN high ELSE low + 90 END, coalesce(duration_sec, 'infinity'::DOUBLE)) AS end_sec
           FROM pairs p LEFT JOIN durations USING (video_id)) WHERE end_sec > start_sec
           UNION ALL SELECT video_id, 0, 0.0, least(90.0, duration_sec) FROM durations WHERE duration_sec > 0 AND video_id NOT IN (SELECT video_id FROM markers))"""
BASE = f"WITH {SEGMENTS},{MARKERS},{RANGES}"


def segments_of(spark: SparkSession, d: str) -> DataFrame:
    """Segments of a data folder, derived once."""
    return derived.held(spark, d, "segments", lambda: derived.segments(derived.table(spark, d, "documents")))


def markers_of(spark: SparkSession, d: str) -> DataFrame:
    """Markers of a data folder."""
    return derived.markers(derived.table(spark, d, "events"))


def durations_of(spark: SparkSession, d: str) -> DataFrame:
    """Durations of a data folder's videos, counted once from the texts."""
    return derived.held(spark, d, "durations", lambda: derived.text_durations(derived.table(spark, d, "documents")))


def ranges_of(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of a data folder's markers, derived once."""
    return derived.held(spark, d, "ranges", lambda: I.marker_ranges(markers_of(spark, d), durations_of(spark, d)))


def listed_of(spark: SparkSession, d: str) -> DataFrame:
    """(video_id, ranges) in order."""
    rows = F.array_sort(F.collect_list(F.struct("range_no", "start_sec", "end_sec")))
    return ranges_of(spark, d).groupBy("video_id").agg(F.transform(rows, lambda r: F.struct(r["start_sec"].alias("start_sec"), r["end_sec"].alias("end_sec"))).alias("ranges"))


def inputs_of(spark: SparkSession, d: str, genre: str) -> DataFrame:
    """What input texts are filled with (``prompts.input_values``), a row for each document: the reviewed settings, and all parts of its
    transcript, put together within the row."""
    docs = derived.table(spark, d, "documents").select("doc_id", "text", F.concat(F.lit("/v/"), F.col("doc_id").cast("string"), F.lit(".mp4")).alias("video_path"), F.col("lang").alias("source_language"))
    reviewed = spark.range(1).select(F.lit(genre).alias("genre"), F.lit("Medium").alias("clip_length_preset"), F.array(F.lit("a"), F.lit("b")).alias("keywords"), F.lit(0.0).alias("range_start_sec"), F.lit(90.0).alias("range_end_sec"))
    base = I.with_settings(derived.lined(docs, listed_of(spark, d), E.names_of(derived.line_texts(docs))), reviewed)
    base = base.withColumn("selected_sec", L.selected_of("lines", "ranges", F.col("range_start_sec"), F.col("range_end_sec"))).withColumn("scope", text.scope("selected_sec"))
    return base.withColumns({"timeline": L.timeline_of("lines"), "context": L.context_of("lines", "ranges"), "transcript": L.transcript_of("lines", "ranges")})


def points_of(spark: SparkSession, d: str) -> DataFrame:
    """Events other than clicks, as points in time."""
    events = derived.table(spark, d, "events").where("event_type <> 'click'").withColumn("event_type", F.lit("click"))
    return derived.markers(events).select("video_id", F.col("marker_id").alias("point_id"), F.col("marker_sec").alias("point_sec"))


POINTS = "points AS (SELECT user_id::BIGINT AS video_id, event_id::BIGINT AS point_id, (epoch_us(ts::TIMESTAMP) % 600000000) / 1e6::DOUBLE AS point_sec FROM events WHERE event_type <> 'click')"
CLIPPED = """
hits AS (SELECT s.video_id, s.seg_no, greatest(s.start_sec, r.start_sec) AS start_sec, least(s.end_sec, r.end_sec) AS end_sec, text,
                row_number() OVER (PARTITION BY s.video_id, s.seg_no ORDER BY r.range_no) AS k
         FROM segments s JOIN ranges r ON s.video_id = r.video_id AND s.end_sec > r.start_sec AND s.start_sec < r.end_sec),
clipped AS (SELECT video_id, seg_no, start_sec, end_sec, text FROM hits WHERE k = 1
            UNION ALL SELECT * FROM segments WHERE video_id NOT IN (SELECT video_id FROM ranges))"""


@query(f"{BASE},{CLIPPED} SELECT video_id, seg_no::BIGINT AS seg_no, start_sec, end_sec, text FROM clipped")
def clip_transcript(spark: SparkSession, d: str) -> DataFrame:
    """Segments clipped to the first range that they overlap."""
    return I.clip_to_first(segments_of(spark, d), ranges_of(spark, d))


@query(f"{BASE} SELECT video_id, range_no::BIGINT AS range_no, start_sec, end_sec FROM ranges")
def marker_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Markers paired into ranges."""
    return ranges_of(spark, d)


@query(f"{BASE} SELECT video_id, count(*)::BIGINT AS n_ranges, sum(end_sec - start_sec) AS total_sec, ceil(sum(end_sec - start_sec) / 60)::BIGINT AS credits FROM ranges GROUP BY video_id")
def range_totals(spark: SparkSession, d: str) -> DataFrame:
    """Total length and credits of ranges."""
    return A.range_totals(ranges_of(spark, d))


@query(f"{BASE} SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY range_no)::BIGINT AS row_no, start_sec, end_sec, end_sec - start_sec AS length_sec FROM ranges")
def range_table(spark: SparkSession, d: str) -> DataFrame:
    """Numbered ranges with lengths."""
    return A.range_table(ranges_of(spark, d))


@query(f"{BASE} SELECT video_id, seg_no::BIGINT AS seg_no, start_sec, end_sec, text FROM segments s WHERE EXISTS (SELECT 1 FROM ranges r WHERE r.video_id = s.video_id AND s.end_sec > greatest(r.start_sec - 60, 0) AND s.start_sec < r.end_sec + 60)")
def context_semi(spark: SparkSession, d: str) -> DataFrame:
    """Segments near a range."""
    return I.within_padding(segments_of(spark, d), ranges_of(spark, d))


@query(f"""{BASE}, shown AS (SELECT *, '[' || printf('%.2f', start_sec) || 's-' || printf('%.2f', end_sec) || 's] ' || text AS line FROM segments),
run AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY video_id ORDER BY seg_no) AS total FROM shown)
SELECT video_id, seg_no::BIGINT AS seg_no, total::BIGINT AS running_chars, total >= {text.MOST_CONTEXT_CHARS} AS cut FROM run WHERE total - length(line) - 1 < {text.MOST_CONTEXT_CHARS}""")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    """Segments whose lines fit into the budget of the operator, 60,000 characters."""
    return T.within_budget(segments_of(spark, d)).select("video_id", "seg_no", F.col("running_chars").cast("long").alias("running_chars"), "cut")


@query(f"""{BASE}, wide AS (SELECT video_id, greatest(start_sec - 60, 0) AS a, end_sec + 60 AS b FROM ranges WHERE end_sec > start_sec),
reach AS (SELECT *, max(b) OVER (PARTITION BY video_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM wide),
numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) - 1 AS range_no FROM reach)
SELECT video_id, range_no::BIGINT AS range_no, min(a) AS start_sec, max(b) AS end_sec FROM numbered GROUP BY 1, 2""")
def coalesce_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Ranges widened and merged."""
    return I.coalesced(ranges_of(spark, d), 60.0)


@query(f"""{BASE} SELECT video_id, range_no::BIGINT AS range_no, start_sec, end_sec, sum(end_sec - start_sec) OVER w AS new_end_sec, sum(end_sec - start_sec) OVER w - (end_sec - start_sec) AS new_start_sec
FROM ranges WINDOW w AS (PARTITION BY video_id ORDER BY range_no ROWS UNBOUNDED PRECEDING)""")
def compact_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Ranges laid end to end."""
    return I.compacted(ranges_of(spark, d)).select("video_id", "range_no", "start_sec", "end_sec", "new_end_sec", "new_start_sec")


@query(f"""{BASE}, laid AS (SELECT *, sum(end_sec - start_sec) OVER (PARTITION BY video_id ORDER BY range_no ROWS UNBOUNDED PRECEDING) - (end_sec - start_sec) AS at FROM ranges)
SELECT s.video_id, (row_number() OVER (PARTITION BY s.video_id ORDER BY r.range_no, s.seg_no) - 1)::BIGINT AS seg_no,
greatest(s.start_sec, r.start_sec) + (r.at - r.start_sec) AS start_sec, least(s.end_sec, r.end_sec) + (r.at - r.start_sec) AS end_sec, text
FROM segments s JOIN laid r ON s.video_id = r.video_id AND s.end_sec > r.start_sec AND s.start_sec < r.end_sec""")
def remap_transcript(spark: SparkSession, d: str) -> DataFrame:
    """Segments moved to the compacted timeline."""
    return I.remapped(segments_of(spark, d), ranges_of(spark, d))


@query(f"{BASE} SELECT s.video_id, s.seg_no::BIGINT AS seg_no, r.range_no::BIGINT AS range_no, greatest(s.start_sec, r.start_sec) AS start_sec, least(s.end_sec, r.end_sec) AS end_sec FROM segments s JOIN ranges r ON s.video_id = r.video_id AND s.end_sec > r.start_sec AND s.start_sec < r.end_sec")
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All overlaps of segments and ranges, joined by time bucket for long videos (R9, R2 on skew)."""
    pairs = I.bucketed_overlaps(segments_of(spark, d), ranges_of(spark, d))
    return pairs.select("video_id", "seg_no", "range_no", F.greatest("start_sec", "from_sec").alias("start_sec"), F.least("end_sec", "to_sec").alias("end_sec"))


@query(f"""WITH {SEGMENTS},{MARKERS}, {POINTS}
SELECT p.video_id, p.point_id, m.marker_sec, m.marker_id, abs(m.marker_sec - p.point_sec) AS distance_sec FROM points p JOIN markers m ON m.video_id = p.video_id AND abs(m.marker_sec - p.point_sec) <= 10
QUALIFY row_number() OVER (PARTITION BY p.video_id, p.point_id ORDER BY abs(m.marker_sec - p.point_sec), m.marker_sec DESC, m.marker_id DESC) = 1""")
def nearest_marker(spark: SparkSession, d: str) -> DataFrame:
    """The marker nearest to each point within 10 s."""
    return I.nearest_marker(points_of(spark, d), markers_of(spark, d), 10.0)


@query(f"""{BASE}, {POINTS}
SELECT p.video_id, p.point_id, p.point_sec, r.range_no::BIGINT AS range_no, coalesce(r.start_sec, p.point_sec) AS start_sec, coalesce(r.end_sec, p.point_sec + 90) AS end_sec
FROM points p LEFT JOIN ranges r ON r.video_id = p.video_id AND p.point_sec BETWEEN r.start_sec AND r.end_sec
QUALIFY row_number() OVER (PARTITION BY p.video_id, p.point_id ORDER BY r.range_no) = 1""")
def point_in_range(spark: SparkSession, d: str) -> DataFrame:
    """The first range that holds each point."""
    return I.range_at(points_of(spark, d), ranges_of(spark, d))


@query(f"{BASE} SELECT video_id, unnest([start_sec, end_sec]) AS marker_sec FROM ranges")
def range_markers(spark: SparkSession, d: str) -> DataFrame:
    """Two markers for each range."""
    return I.markers_of(ranges_of(spark, d))


@query(f"""WITH {MARKERS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY marker_sec, marker_id) - 1 AS nth FROM markers)
SELECT video_id, marker_id, marker_sec FROM ranked WHERE nth >= 2""")
def remove_first_range(spark: SparkSession, d: str) -> DataFrame:
    """Markers without those of each video's first range."""
    m = markers_of(spark, d)
    doomed = m.select("video_id", F.lit(0).cast("long").alias("range_no")).distinct()
    return I.without_range(m, doomed).select("video_id", "marker_id", "marker_sec")


@query(f"""WITH {SEGMENTS}, parts AS (SELECT doc_id AS video_id, ((doc_id % 7) * 10)::DOUBLE AS start_sec, ((doc_id % 5) * 15)::DOUBLE AS end_sec FROM documents WHERE doc_id % 3 <> 0),
overall AS (SELECT doc_id AS video_id, (doc_id % 4)::DOUBLE AS a, (doc_id % 6 * 5)::DOUBLE AS b FROM documents),
good AS (SELECT * FROM parts WHERE end_sec > start_sec)
SELECT 'usable' AS kind, * FROM good UNION ALL SELECT 'usable', video_id, a, b FROM overall WHERE b > a AND video_id NOT IN (SELECT video_id FROM good)
UNION ALL SELECT 'projected', * FROM good UNION ALL SELECT 'projected', video_id, a, b FROM overall WHERE b > a AND video_id NOT IN (SELECT video_id FROM parts)
UNION ALL SELECT 'finite', * FROM good UNION ALL SELECT 'finite', video_id, a, b FROM overall WHERE b > a AND video_id NOT IN (SELECT video_id FROM parts)""")
def valid_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Three ways to validate ranges, which differ where none survives."""
    docs = derived.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"))
    parts = docs.where("video_id % 3 <> 0").select("video_id", F.lit(0).cast("long").alias("range_no"), (F.col("video_id") % 7 * 10).cast("double").alias("start_sec"), (F.col("video_id") % 5 * 15).cast("double").alias("end_sec"))
    overall = docs.select("video_id", (F.col("video_id") % 4).cast("double").alias("range_start_sec"), (F.col("video_id") % 6 * 5).cast("double").alias("range_end_sec"))
    named = [f(parts, overall).select(F.lit(f.__name__).alias("kind"), "video_id", "start_sec", "end_sec") for f in (I.usable, I.projected, I.finite)]
    return named[0].unionByName(named[1]).unionByName(named[2])


WINDOWED = """
anchored AS (SELECT *, max(greatest(floor(start_sec / 300) * 300, 0)) OVER (PARTITION BY video_id ORDER BY seg_no) AS window_sec FROM segments)"""


@query(f"WITH {SEGMENTS},{WINDOWED} SELECT video_id, window_sec, count(*)::BIGINT AS n_segments, min(start_sec) AS first_sec, max(end_sec) AS last_sec FROM anchored GROUP BY 1, 2")
def timeline_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of 300 s."""
    return T.window_totals(segments_of(spark, d))


@query(f"""WITH {SEGMENTS}, placed AS (SELECT d.lang AS channel, s.*, s.end_sec - s.start_sec AS secs FROM segments s JOIN documents d ON d.doc_id = s.video_id)
SELECT channel, video_id, seg_no, sum(secs) OVER w - secs AS start_sec, sum(secs) OVER w AS end_sec, (sum(length(text) + 1) OVER w)::BIGINT AS running_chars
FROM placed WINDOW w AS (PARTITION BY channel ORDER BY video_id, seg_no)""")
def channel_timeline(spark: SparkSession, d: str) -> DataFrame:
    """All videos of a language laid end to end, by running sums across stretches."""
    videos = derived.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.col("lang").alias("channel"))
    return T.channel_timeline(segments_of(spark, d), videos)


@query(f"""WITH {SEGMENTS},{WINDOWED}, grouped AS (SELECT video_id, window_sec, list(text ORDER BY seg_no) AS texts FROM anchored GROUP BY 1, 2)
SELECT video_id, window_sec, list_reduce(texts, lambda a, x: CASE WHEN length(a) >= 520 THEN a ELSE
  (CASE WHEN a = '' THEN '' ELSE a || ' ' END) || (CASE WHEN length(x) <= 520 - length(CASE WHEN a = '' THEN '' ELSE a || ' ' END) THEN x
   ELSE {TRIM.format("left(x, greatest(0, 520 - length(CASE WHEN a = '' THEN '' ELSE a || ' ' END)))")} || '...' END) END, '') AS preview FROM grouped""")
def timeline_preview(spark: SparkSession, d: str) -> DataFrame:
    """Previews of windows, cut at 520 characters."""
    return T.window_previews(segments_of(spark, d))


@query(f"""WITH {SEGMENTS},{WINDOWED}, grouped AS (SELECT video_id, window_sec, list(text ORDER BY seg_no) AS texts FROM anchored GROUP BY 1, 2),
shown AS (SELECT video_id, window_sec, list_reduce(texts, lambda a, x: CASE WHEN length(a) >= 520 THEN a ELSE
  (CASE WHEN a = '' THEN '' ELSE a || ' ' END) || (CASE WHEN length(x) <= 520 - length(CASE WHEN a = '' THEN '' ELSE a || ' ' END) THEN x
   ELSE {TRIM.format("left(x, greatest(0, 520 - length(CASE WHEN a = '' THEN '' ELSE a || ' ' END)))")} || '...' END) END, '') AS preview FROM grouped)
SELECT video_id, string_agg('[' || printf('%.0f', window_sec) || 's-' || printf('%.0f', window_sec + 300) || 's] ' || preview, chr(10) ORDER BY window_sec) AS timeline FROM shown GROUP BY 1""")
def timeline_text(spark: SparkSession, d: str) -> DataFrame:
    """The whole timeline of a video as text."""
    return T.timeline_text(segments_of(spark, d))


@query(f"""{BASE}, overall AS (SELECT doc_id AS video_id, 0.0::DOUBLE AS a, ((doc_id % 3) * 50)::DOUBLE AS b FROM documents),
chosen AS (SELECT video_id, sum(end_sec - start_sec) AS s FROM ranges GROUP BY 1),
totals AS (SELECT video_id, count(*) AS n, sum(length(text)) AS c, max(end_sec) - min(start_sec) AS span FROM segments GROUP BY 1),
joined AS (SELECT o.video_id, coalesce(nullif(greatest(s, 0), 0), nullif(greatest(b - a, 0), 0), nullif(greatest(span, 0), 0), 0) AS selected_sec, coalesce(n, 0)::BIGINT AS n_segments, coalesce(c, 0)::BIGINT AS n_chars
           FROM overall o LEFT JOIN chosen USING (video_id) LEFT JOIN totals USING (video_id))
SELECT *, CASE WHEN selected_sec >= 2400 THEN 'large_range_multiple_clips' WHEN selected_sec >= 600 THEN 'medium_range_one_or_more_clips' ELSE 'short_range_best_moment' END AS scope,
selected_sec < 90 OR n_segments < 8 OR n_chars < 400 AS may_have_no_clip FROM joined""")
def curation_scope(spark: SparkSession, d: str) -> DataFrame:
    """Selected duration, transcript size and scope."""
    overall = derived.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.lit(0.0).alias("range_start_sec"), (F.col("doc_id") % 3 * 50).cast("double").alias("range_end_sec"))
    return A.selected_duration(segments_of(spark, d), ranges_of(spark, d), overall)


@query(f"""{BASE}, t AS (SELECT video_id, count(*)::BIGINT AS n_ranges, sum(end_sec - start_sec) AS selected_sec FROM ranges GROUP BY 1)
SELECT video_id, duration_sec AS original_sec, selected_sec, n_ranges, (duration_sec - selected_sec) / duration_sec * 100 AS saved_percent,
n_ranges > 0 AND selected_sec > 0 AND selected_sec < duration_sec AND (duration_sec - selected_sec) / duration_sec * 100 >= 60 AS resample FROM durations JOIN t USING (video_id)""")
def resample_decision(spark: SparkSession, d: str) -> DataFrame:
    """Whether cutting a video pays."""
    totals = A.range_totals(ranges_of(spark, d)).join(derived.durations(segments_of(spark, d)), "video_id")
    return A.resample_decision(totals.select("video_id", F.col("duration_sec").alias("original_sec"), F.col("total_sec").alias("selected_sec"), "n_ranges"))


IGNORED_SQL = ", ".join(f"'{w}'" for w in E.IGNORED)
PREFIXES_SQL = ", ".join(f"'{w}'" for w in E.IGNORED_PREFIXES)


@query(f"""WITH {SEGMENTS}, plain AS (SELECT video_id, regexp_replace(unnest(regexp_extract_all(text, '{E.NAME}', 1)), '\\s+', ' ', 'g') AS name FROM segments),
led AS (SELECT video_id, string_split(regexp_replace(unnest(regexp_extract_all(text, '{E.PREFIXED}', 1)), '\\s+', ' ', 'g'), ' ') AS w FROM segments),
both_ AS (SELECT video_id, name, 1 AS weight FROM plain WHERE split_part(name, ' ', 1) NOT IN ({IGNORED_SQL})
UNION ALL SELECT video_id, upper(left(lower(w[1]), 1)) || substr(lower(w[1]), 2) || ' ' || array_to_string(w[2:], ' '), 2 FROM led WHERE lower(w[1]) NOT IN ({PREFIXES_SQL}) AND w[2] NOT IN ({IGNORED_SQL}))
SELECT video_id, name, sum(weight)::BIGINT AS n FROM both_ GROUP BY 1, 2""")
def name_counts(spark: SparkSession, d: str) -> DataFrame:
    """Capitalised names and how often they occur."""
    return E.name_counts(segments_of(spark, d))


@query("""SELECT doc_id AS video_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'auto' END AS prompt_language, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'pt' END AS language,
CASE doc_id % 4 WHEN 1 THEN 'Short' WHEN 2 THEN 'Medium' WHEN 3 THEN 'Long' ELSE 'Auto' END AS preset, CASE doc_id % 4 WHEN 1 THEN 30.0 WHEN 2 THEN 60.0 WHEN 3 THEN 120.0 END::DOUBLE AS low_sec,
CASE doc_id % 4 WHEN 1 THEN 60.0 WHEN 2 THEN 120.0 WHEN 3 THEN 180.0 END::DOUBLE AS high_sec FROM documents""")
def language_and_preset(spark: SparkSession, d: str) -> DataFrame:
    """Languages and presets by their aliases."""
    s = derived.settings(derived.table(spark, d, "documents"))
    raw = F.when(F.col("video_id") % 2 == 0, F.concat(F.lit(" "), F.upper("source_language"))).otherwise("Pt-BR")
    return s.select("video_id", text.language("source_language", others=False).alias("prompt_language"), text.language(raw, others=True).alias("language"), text.preset("clip_length_preset").alias("preset"), text.preset_bound("clip_length_preset", 0).alias("low_sec"), text.preset_bound("clip_length_preset", 1).alias("high_sec"))


@query(f"""WITH {SEGMENTS} SELECT video_id, seg_no::BIGINT AS seg_no, printf('%02d:%02d:%02d', (round(end_sec)::BIGINT // 3600), (round(end_sec)::BIGINT % 3600 // 60), round(end_sec)::BIGINT % 60) AS rounded,
printf('%02d:%02d:%02d', (floor(end_sec)::BIGINT // 3600), (floor(end_sec)::BIGINT % 3600 // 60), floor(end_sec)::BIGINT % 60) AS truncated, round(end_sec * 1000)::BIGINT AS token,
'[' || printf('%.2f', start_sec) || 's-' || printf('%.2f', end_sec) || 's] ' || text AS line FROM segments""")
def clocks(spark: SparkSession, d: str) -> DataFrame:
    """Times as clocks, tokens and lines."""
    s = segments_of(spark, d)
    return s.select("video_id", "seg_no", text.clock("end_sec", rounded=True).alias("rounded"), text.clock("end_sec", rounded=False).alias("truncated"), text.time_token("end_sec").alias("token"), text.segment_line("start_sec", "end_sec", "text").alias("line"))


@query(f"WITH {SEGMENTS} SELECT video_id, md5(string_agg('[' || printf('%.2f', start_sec) || 's-' || printf('%.2f', end_sec) || 's] ' || text, chr(10) ORDER BY seg_no)) AS digest FROM segments GROUP BY 1")
def transcript_text(spark: SparkSession, d: str) -> DataFrame:
    """Whole transcripts as text, digested."""
    return T.transcript_text(segments_of(spark, d)).select("video_id", F.md5("transcript").alias("digest"))


@query(f"""{BASE}, listed AS (SELECT video_id, string_agg(printf('%.3f', start_sec) || '_' || printf('%.3f', end_sec), '|' ORDER BY range_no) AS r, string_agg(round(start_sec * 1000)::BIGINT || '-' || round(end_sec * 1000)::BIGINT, '_' ORDER BY range_no) AS t FROM ranges GROUP BY 1),
f AS (SELECT doc_id, '/videos/' || source || '/clip ' || doc_id || '.mp4' AS path, 'clip ' || doc_id || '.mp4' AS name, n_chars, lang FROM documents),
i AS (SELECT *, left(sha256(path || chr(10) || n_chars || chr(10) || strftime(TIMESTAMP '2024-01-01' + to_seconds(doc_id), '%Y-%m-%dT%H:%M:%S.000Z')), 24) AS id FROM f)
SELECT doc_id AS video_id, 'video_transcript.' || id || '.' || lang AS whole_key, 'video_transcript_range.' || id || '.' || lang || '.' || left(sha256(coalesce(r, '')), 24) AS range_key, 'gpt_prompt.' || left(sha256(name), 24) AS prompt_key,
'video_markers.' || rtrim(replace(replace(to_base64(name::BLOB), '+', '-'), '/', '_'), '=') AS markers_key, 'review.settings.' || rtrim(replace(replace(to_base64(name::BLOB), '+', '-'), '/', '_'), '=') || '.' || coalesce(t, 'no_markers') AS review_key FROM i LEFT JOIN listed ON video_id = doc_id""")
def file_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of files, transcripts, prompts, markers and reviews (section 1.3)."""
    docs = derived.table(spark, d, "documents")
    listed = ranges_of(spark, d).groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("range_no", "start_sec", "end_sec"))), lambda r: F.struct(r["start_sec"].alias("start_sec"), r["end_sec"].alias("end_sec"))).alias("ranges"))
    f = docs.select(F.col("doc_id").alias("video_id"), F.concat(F.lit("/videos/"), "source", F.lit("/clip "), F.col("doc_id").cast("string"), F.lit(".mp4")).alias("path"), "n_chars", "lang", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("doc_id").cast("decimal(18,6)"))).alias("modified"))
    f = f.join(listed, "video_id", "left").withColumn("ranges", F.coalesce("ranges", F.array().cast("array<struct<start_sec:double,end_sec:double>>"))).withColumn("id", K.file_identity("path", "n_chars", "modified"))
    return f.select("video_id", K.transcript_key("id", "lang").alias("whole_key"), K.range_transcript_key("id", "lang", "ranges").alias("range_key"), K.prompt_video_key("path").alias("prompt_key"), K.markers_key("path").alias("markers_key"), K.review_key_of_ranges("path", "ranges").alias("review_key"))


@query("""SELECT vec_id::BIGINT AS stream_id, len(embedding)::BIGINT AS n_samples, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS peak,
list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) > 1e-5 OR list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) > 0 AS audible FROM embeddings""")
def pcm_audible(spark: SparkSession, d: str) -> DataFrame:
    """Peak of sound and whether it is audible."""
    return A.audible(derived.pcm(derived.table(spark, d, "embeddings"))).select("stream_id", "n_samples", "peak", "audible")


@query("""SELECT vec_id::BIGINT AS stream_id, generate_subscripts(embedding, 1) - 1 AS sample_no FROM embeddings WHERE false
UNION ALL SELECT stream_id, n::BIGINT AS sample_no FROM (SELECT vec_id::BIGINT AS stream_id, greatest(1, floor(len(embedding) / (44100 / 16000::DOUBLE))) AS n FROM embeddings)""")
def pcm_resample_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Samples after resampling from 44.1 to 16 kHz."""
    return A.resampled(derived.pcm(derived.table(spark, d, "embeddings")), 44_100, 16_000).select("stream_id", F.size("samples").cast("long").alias("sample_no"))


@query("""WITH e AS (SELECT vec_id::BIGINT AS stream_id, embedding AS s, unnest(range(0, greatest(1, floor(len(embedding) / 2.75625))::BIGINT)) AS i FROM embeddings),
p AS (SELECT *, least(floor(i * 2.75625::DOUBLE)::INTEGER, len(s) - 1) AS low, i * 2.75625::DOUBLE AS place FROM e)
SELECT stream_id, i AS sample_no, (s[low + 1] + ((s[least(low + 1, len(s) - 1) + 1] - s[low + 1])::FLOAT * (place - low)::FLOAT)::FLOAT)::FLOAT AS value FROM p""")
def pcm_resample(spark: SparkSession, d: str) -> DataFrame:
    """Sound resampled from 44.1 to 16 kHz in 32-bit steps."""
    out = A.resampled(derived.pcm(derived.table(spark, d, "embeddings")), 44_100, 16_000)
    return out.select("stream_id", F.posexplode("samples").alias("sample_no", "value")).select("stream_id", F.col("sample_no").cast("long").alias("sample_no"), "value")


@query("SELECT vec_id::BIGINT AS stream_id, unnest(range(0, ceil(len(embedding) / 24)::BIGINT)) AS chunk_no, unnest(list_transform(range(0, ceil(len(embedding) / 24)::BIGINT), lambda c: least(24, len(embedding) - c * 24)))::BIGINT AS n_samples FROM embeddings")
def sound_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Sound in chunks of 24 samples, the last one shorter."""
    return A.sound_chunks(derived.pcm(derived.table(spark, d, "embeddings")), size=24).select("stream_id", "chunk_no", F.size("samples").cast("long").alias("n_samples"))


@query(f"""{BASE} SELECT video_id, range_no::BIGINT AS range_no, CASE WHEN video_id % 2 = 0 THEN start_sec ELSE CASE video_id % 4 WHEN 1 THEN 30.0 WHEN 3 THEN 120.0 END END AS low_sec,
CASE WHEN video_id % 2 = 0 THEN end_sec ELSE CASE video_id % 4 WHEN 1 THEN 60.0 WHEN 3 THEN 180.0 END END AS high_sec, CASE WHEN video_id % 2 = 0 THEN end_sec - start_sec END AS fixed_sec FROM ranges WHERE video_id IN (SELECT doc_id FROM documents)""")
def project_payload(spark: SparkSession, d: str) -> DataFrame:
    """Request bodies of ranges, read back."""
    s = ranges_of(spark, d).join(derived.settings(derived.table(spark, d, "documents")), "video_id")
    s = s.select("video_id", "range_no", "start_sec", "end_sec", "skip_curate", "clip_length_preset", "source_language", F.lit("").alias("model"), F.lit("").alias("genre"), F.lit("").alias("ai_prompt"), F.lit("").alias("brand_template_id"), F.array(F.lit("topic")).alias("keywords"), F.concat(F.lit("up-"), F.col("video_id").cast("string")).alias("upload_id"))
    body = F.from_json("body", "curationPref struct<clipDurations:array<array<double>>,clip_duration:array<double>>")["curationPref"]
    pair = F.try_element_at(body["clipDurations"], F.lit(1))
    return P.project_request(s).select("video_id", "range_no", F.try_element_at(pair, F.lit(1)).alias("low_sec"), F.try_element_at(pair, F.lit(2)).alias("high_sec"), F.try_element_at(body["clip_duration"], F.lit(1)).alias("fixed_sec"))


@query("SELECT doc_id AS request_id, CASE WHEN doc_id % 3 = 0 THEN 'w' || doc_id WHEN doc_id % 5 = 0 THEN 'r' || doc_id END AS value, CASE WHEN doc_id % 3 = 0 THEN 'file' WHEN doc_id % 5 = 0 THEN 'ranges' ELSE 'compute' END AS source FROM documents")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Cached transcripts of files, else of ranges."""
    docs = derived.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("s"))
    keyed = docs.select(F.col("doc_id").alias("request_id"), F.concat(F.lit("t."), "s").alias("whole_key"), F.concat(F.lit("t."), "s", F.lit(".r")).alias("range_key"))
    cache = docs.where("doc_id % 3 = 0").select(F.concat(F.lit("t."), "s").alias("key"), F.concat(F.lit("w"), "s").alias("value")).unionByName(docs.where("doc_id % 5 = 0").select(F.concat(F.lit("t."), "s", F.lit(".r")).alias("key"), F.concat(F.lit("r"), "s").alias("value")))
    return I.looked_up(keyed, cache)


STORE = "SELECT CASE doc_id % 3 WHEN 0 THEN 'gpt_prompt.' WHEN 1 THEN 'gpt_prompt_input.v15.' ELSE 'video_markers.' END || doc_id AS key, source AS value FROM documents"


@query(f"SELECT * FROM ({STORE}) WHERE NOT starts_with(key, 'gpt_prompt.')")
def cache_purge(spark: SparkSession, d: str) -> DataFrame:
    """A store without the keys of a prefix (K3)."""
    return store.purged(store_of(spark, d), ["gpt_prompt."])


@query(f"SELECT key, CASE WHEN c.value IS NULL THEN s.value ELSE c.value END AS value FROM ({STORE}) s LEFT JOIN (SELECT 'video_markers.' || doc_id AS key, 'new' AS value FROM documents WHERE doc_id % 6 = 2) c USING (key)")
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A store with changes, the last of which wins (K1)."""
    ids = derived.table(spark, d, "documents").where("doc_id % 6 = 2").select(F.concat(F.lit("video_markers."), F.col("doc_id").cast("string")).alias("key"))
    changes = ids.select("key", F.lit("old").alias("value"), F.lit(1).alias("change_no")).unionByName(ids.select("key", F.lit("new").alias("value"), F.lit(2).alias("change_no")))
    return store.upserted(store_of(spark, d), changes)


def store_of(spark: SparkSession, d: str) -> DataFrame:
    """A store made from documents."""
    return derived.table(spark, d, "documents").select(F.expr("concat(CASE doc_id % 3 WHEN 0 THEN 'gpt_prompt.' WHEN 1 THEN 'gpt_prompt_input.v15.' ELSE 'video_markers.' END, doc_id)").alias("key"), F.col("source").alias("value"))


@query(f"WITH {MARKERS} SELECT video_id, string_agg(printf('%.3f', marker_sec), ';' ORDER BY marker_sec) AS value FROM markers GROUP BY 1")
def marker_values(spark: SparkSession, d: str) -> DataFrame:
    """Markers as they are saved (K6, K7)."""
    return store.marker_values(markers_of(spark, d))


@query(f"WITH {MARKERS} SELECT video_id::VARCHAR AS key, printf('%.3f', marker_sec)::DOUBLE AS marker_sec FROM markers")
def saved_markers(spark: SparkSession, d: str) -> DataFrame:
    """Saved markers read back."""
    saved = store.marker_values(markers_of(spark, d)).select(F.col("video_id").cast("string").alias("key"), "value")
    return files.saved_markers(saved)


@query(f"WITH {SEGMENTS} SELECT video_id::VARCHAR AS key, (row_number() OVER (PARTITION BY video_id ORDER BY seg_no) - 1)::BIGINT AS seg_no, start_sec, end_sec, text FROM segments")
def saved_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts written as JSON and read back."""
    videos = derived.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.lit("/v/a.mp4").alias("path"), F.col("lang").alias("language"))
    held = store.transcript_objects(segments_of(spark, d), videos)
    return files.transcripts(held.select(F.col("video_id").cast("string").alias("key"), "value"))


STATES = "(['pending', 'running', 'succeeded', 'failed', 'canceled'])[event_id % 5 + 1]"


@query(f"""WITH log AS (SELECT event_id::BIGINT AS seq, user_id::BIGINT AS job_id, {STATES} AS state, (event_id % 101)::BIGINT AS progress, CASE WHEN event_id % 2 = 0 THEN event_type ELSE ' ' END AS message FROM events)
SELECT job_id, arg_max(state, seq) AS state, arg_max(progress, seq) AS progress, arg_max(message, seq) FILTER (WHERE trim(message) <> '') AS message, max(seq) AS last_seq FROM log GROUP BY 1""")
def job_states(spark: SparkSession, d: str) -> DataFrame:
    """The last state of each job."""
    return jobs.job_states(log_of(spark, d))


@query(f"""WITH log AS (SELECT event_id::BIGINT AS seq, user_id::BIGINT AS job_id, {STATES} AS state, (event_id % 101)::BIGINT AS progress FROM events),
s AS (SELECT job_id, arg_max(state, seq) AS state, arg_max(progress, seq) AS progress FROM log GROUP BY 1),
t AS (SELECT floor(sum(CASE WHEN state IN ('succeeded', 'failed', 'canceled') THEN 100 ELSE progress END) / count(*))::BIGINT AS progress, count(*) AS n_jobs, count(*) FILTER (WHERE state IN ('succeeded', 'failed', 'canceled')) AS n_done,
count(*) FILTER (WHERE state = 'failed') AS n_failed, count(*) FILTER (WHERE state = 'canceled') AS n_canceled FROM s)
SELECT *, CASE WHEN n_done < n_jobs THEN 'running' WHEN n_canceled > 0 THEN 'canceled' WHEN n_failed > 0 THEN 'failed' ELSE 'success' END AS outcome FROM t""")
def batch_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Progress and outcome of a batch."""
    return jobs.batch_outcome(jobs.job_states(log_of(spark, d))).select("progress", "n_jobs", "n_done", "n_failed", "n_canceled", "outcome")


def log_of(spark: SparkSession, d: str) -> DataFrame:
    """A job log made from events."""
    states = F.array(*map(F.lit, ("pending", "running", "succeeded", "failed", "canceled")))
    return derived.table(spark, d, "events").select(F.col("event_id").cast("long").alias("seq"), F.col("user_id").cast("long").alias("job_id"), F.element_at(states, (F.col("event_id") % 5 + 1).cast("int")).alias("state"), (F.col("event_id") % 101).cast("long").alias("progress"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(" ").alias("message"))


@query("""WITH e AS (SELECT user_id::BIGINT AS session_id, event_id::BIGINT AS event_no, CASE WHEN event_id % 2 = 0 THEN 'start' ELSE 'stop' END AS kind, epoch_us(ts::TIMESTAMP) AS us FROM events),
n AS (SELECT *, lead(kind) OVER w AS k2, lead(us) OVER w AS us2 FROM e WINDOW w AS (PARTITION BY session_id ORDER BY event_no))
SELECT session_id, event_no, us - 10000000 AS start_us, us2 + 10000000 AS end_us FROM n WHERE kind = 'start' AND k2 = 'stop'""")
def recording_windows(spark: SparkSession, d: str) -> DataFrame:
    """Starts paired with stops, widened by 10 s."""
    events = derived.table(spark, d, "events").select(F.col("user_id").cast("long").alias("session_id"), F.col("event_id").cast("long").alias("event_no"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("stop").alias("kind"), F.col("ts").cast("timestamp_ntz").alias("at"))
    us = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c))
    return files.recording_windows(events).select("session_id", "event_no", us("start_at").alias("start_us"), us("end_at").alias("end_us"))


@query(f"SELECT doc_id AS reply_id, {TRIM.format('text')} AS reply FROM documents WHERE {TRIM.format('text')} <> ''")
def reply_extract(spark: SparkSession, d: str) -> DataFrame:
    """Texts of replies in three shapes of envelope."""
    docs = derived.table(spark, d, "documents").where(text.trimmed("text") != "")
    t = text.trimmed("text")
    body = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.array(F.struct(F.struct(F.lit(" ").alias("content")).alias("message")), F.struct(F.struct(t.alias("content")).alias("message"))).alias("choices"))))
    body = body.when(F.col("doc_id") % 3 == 1, F.to_json(F.struct(t.alias("output_text")))).otherwise(F.to_json(F.struct(F.array(F.struct(F.array(F.struct(t.alias("text"))).alias("content"))).alias("output"))))
    return docs.select(F.col("doc_id").alias("reply_id"), P.reply_text(body).alias("reply"))


@query(f"""SELECT doc_id AS plan_id, CASE WHEN doc_id % 5 = 0 THEN 'NO_STRONG_CLIP_FOUND: nothing in ' || lang ELSE
'Find one or more strong self-contained clips where the speaker ' || CASE doc_id % 3 WHEN 0 THEN 'tells' WHEN 1 THEN 'compares' ELSE 'explains' END || ' topic ' || doc_id || ' with context from ' || source ||
'. Prioritize moments that {P.OPENING}, then develop ' || source || '. Prefer clips that {P.ENDING}, with clean natural boundaries and without {P.BOUNDARY}.' END AS prompt FROM documents""")
def plan_render(spark: SparkSession, d: str) -> DataFrame:
    """Structured plans, bare, fenced, wrapped or in prose, as prompts."""
    docs = derived.table(spark, d, "documents")
    arc = F.element_at(F.array(F.lit("story"), F.lit("Comparison "), F.lit("other")), (F.col("doc_id") % 3 + 1).cast("int"))
    plan = F.struct((F.col("doc_id") % 5 == 0).alias("no_strong_clip_found"), F.concat(F.lit("nothing in "), "lang").alias("reason"), arc.alias("arc_type"), F.concat(F.lit("Find one clear clip where the speaker explains topic "), F.col("doc_id").cast("string"), F.lit(".")).alias("main_target"), F.concat(F.lit("- "), "source", F.lit(";")).alias("context_phrase"), F.concat(F.lit("develop  "), "source").alias("development_criteria"))
    shape = F.col("doc_id") % 4
    raw = F.when(shape == 0, F.to_json(plan)).when(shape == 1, F.concat(F.lit("```json\n"), F.to_json(plan), F.lit("\n```"))).when(shape == 2, F.to_json(F.struct(plan.alias("plan")))).otherwise(F.concat(F.lit("Here it is: "), F.to_json(plan), F.lit(" Enjoy.")))
    return docs.select(F.col("doc_id").alias("plan_id"), P.rendered_plan(P.plan_object(raw), F.lit("medium_range_one_or_more_clips"), F.lit("x")).alias("prompt"))


@query()
def input_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Input texts rendered from a template for every video, digested."""
    template = F.lit("{{video_file}} {{range_start_sec}}-{{range_end_sec}} {{genre}} {{selected_ranges}} {{topic_keywords}} {{named_references}} {{source_language}} {{clip_length_preset}} {{selected_duration_sec}} {{selected_duration_min}} {{curation_scope}}\n{{semantic_timeline}}\n{{context_transcript}}\n{{selected_range_transcript}}")
    body = P.chat_request(F.lit("model-a"), P.filled(template, P.input_values()), "Return valid JSON only.")
    made = inputs_of(spark, d, "").select("video_id", body.alias("body"))  # made once, used twice
    return made.select("video_id", F.md5("body").alias("digest"), F.length("body").cast("long").alias("n_chars"))
