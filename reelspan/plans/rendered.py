"""The registered query of whole input texts: templates chosen by language, settings fanned out, every part rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.plans import cases
from reelspan.plans import prompts as P
from reelspan.plans.catalogue import BASE, CLIPPED, TRIM, WINDOWED, inputs_of, query

#: Templates by language; any other language takes that of auto.
TEMPLATES = (
    ("en", "{{video_file}} {{range_start_sec}}-{{range_end_sec}} {{genre}} {{topic_keywords}}\n{{selected_ranges}}\n{{named_references}}\n{{semantic_timeline}}\n{{selected_range_transcript}}"),
    ("auto", "{{source_language}} {{clip_length_preset}} {{selected_duration_sec}} {{selected_duration_min}} {{curation_scope}}\n{{selected_ranges}}\n{{context_transcript}}"), ("de", " \n"),
)
LINE = "'[' || printf('%.2f', start_sec) || 's-' || printf('%.2f', end_sec) || 's] ' || text"
JOINED = "CASE WHEN a = '' THEN '' ELSE a || ' ' END"
NOTE = "chr(10) || chr(10) || '[context truncated to keep the GPT request focused]'"


@query(f"""{BASE},{CLIPPED},{WINDOWED}, {cases.TOP}, {cases.LISTED},
grouped AS (SELECT video_id, window_sec, list(text ORDER BY seg_no) AS texts FROM anchored GROUP BY 1, 2),
shown AS (SELECT video_id, window_sec, list_reduce(texts, lambda a, x: CASE WHEN length(a) >= 520 THEN a ELSE ({JOINED}) || (CASE WHEN length(x) <= 520 - length({JOINED}) THEN x ELSE {TRIM.format(f"left(x, greatest(0, 520 - length({JOINED})))")} || '...' END) END, '') AS preview FROM grouped),
timelines AS (SELECT video_id, string_agg('[' || printf('%.0f', window_sec) || 's-' || printf('%.0f', window_sec + 300) || 's] ' || preview, chr(10) ORDER BY window_sec) AS timeline FROM shown GROUP BY 1),
near AS (SELECT video_id, seg_no, {LINE} AS line FROM segments s WHERE EXISTS (SELECT 1 FROM ranges r WHERE r.video_id = s.video_id AND s.end_sec > greatest(r.start_sec - 60, 0) AND s.start_sec < r.end_sec + 60)),
run AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY video_id ORDER BY seg_no) AS total FROM near),
contexts AS (SELECT video_id, string_agg(line, chr(10) ORDER BY seg_no) || CASE WHEN bool_or(total >= 60000) THEN {NOTE} ELSE '' END AS context FROM run WHERE total - length(line) - 1 < 60000 GROUP BY 1),
said AS (SELECT video_id, string_agg({LINE}, chr(10) ORDER BY seg_no) AS transcript FROM clipped GROUP BY 1),
chosen AS (SELECT video_id, sum(end_sec - start_sec) AS s FROM ranges GROUP BY 1),
parts AS (SELECT doc_id AS video_id, lang, coalesce(nullif(greatest(s, 0), 0), 90.0) AS sec, coalesce(timeline, '') AS timeline, coalesce(context, '') AS context, coalesce(transcript, '') AS transcript,
CASE WHEN rs IS NULL THEN 'There are no specific user-selected ranges/markers. Choose the best moments using the transcript.' ELSE 'User-selected ranges/markers, in priority order:' || chr(10) || array_to_string(list_transform(rs, lambda x, i: i || '. ' || printf('%.3f', x.s) || 's-' || printf('%.3f', x.e) || 's'), chr(10)) END AS listed_,
coalesce(array_to_string(list_transform(r, lambda x: x.name), ', '), '{cases.NO_NAMES}') AS names
FROM documents LEFT JOIN chosen c ON c.video_id = doc_id LEFT JOIN timelines t ON t.video_id = doc_id LEFT JOIN contexts x ON x.video_id = doc_id LEFT JOIN said d ON d.video_id = doc_id LEFT JOIN listed l ON l.video_id = doc_id LEFT JOIN kept k ON k.video_id = doc_id),
texts AS (SELECT video_id, {TRIM.format("CASE WHEN lang = 'en' THEN video_id || '.mp4 0.000-90.000 Auto a, b' || chr(10) || listed_ || chr(10) || names || chr(10) || timeline || chr(10) || transcript ELSE 'auto Medium ' || printf('%.3f', sec) || ' ' || printf('%.2f', sec / 60) || ' ' || CASE WHEN sec >= 2400 THEN 'large_range_multiple_clips' WHEN sec >= 600 THEN 'medium_range_one_or_more_clips' ELSE 'short_range_best_moment' END || chr(10) || listed_ || chr(10) || context END")} AS t FROM parts)
SELECT video_id, md5(t) AS digest, length(t)::BIGINT AS n_chars FROM texts""")
def rendered_inputs(spark: SparkSession, d: str) -> DataFrame:
    """The input text of every video: its language's template, the reviewed settings, and all parts."""
    templates = spark.createDataFrame(TEMPLATES, "language string, template string")
    asked = P.with_template(inputs_of(spark, d, " "), templates, "none", "source_language")
    made = asked.select("video_id", P.filled("template", P.input_values()).alias("t"))  # made once, used twice
    return made.select("video_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n_chars"))
