"""Registered queries of sound in pieces, sound files, the versioned store, and cases that the plain tables don't hold:
every scope, silent sound, cut budgets and all outcomes of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.operators import aggregates as A
from reelspan.operators import sound as S
from reelspan.operators import timeline as T
from reelspan.operators.scan import Fold, dense, running
from reelspan.plans.catalogue import SEGMENTS, STATES, STORE, log_of, query, segments_of, store_of
from reelspan.sources import derived, sound_files
from reelspan.sources.scratch import fresh_folder
from reelspan.sources.versioned import KeyedTable
from reelspan.streaming import jobs

FROM_RATE, TO_RATE, PIECE = 44_100, 16_000, 500
#: One long stream of each label: the embeddings of the label, one after the other.
STREAMS = "streams AS (SELECT coalesce(label, -1)::BIGINT AS stream_id, flatten(list(embedding ORDER BY vec_id)) AS s FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1)"


def label_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The stream of each label in pieces, an embedding each."""
    parts = derived.table(spark, d, "embeddings").where("embedding is not null").select(F.coalesce("label", F.lit(-1)).cast("long").alias("stream_id"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("samples"))
    return S.placed(running(parts, ["stream_id"], ["vec_id"], dense("vec_id", 4096), {"piece_no": Fold("count", F.lit(1), own=False)}).drop("vec_id"))


@query(f"""WITH {STREAMS}, e AS (SELECT stream_id, s, unnest(range(0, greatest(1, floor(len(s) / 2.75625))::BIGINT)) AS i FROM streams),
p AS (SELECT *, least(floor(i * 2.75625::DOUBLE)::BIGINT, len(s) - 1) AS low, i * 2.75625::DOUBLE AS place FROM e)
SELECT stream_id, i AS sample_no, (s[low + 1] + ((s[least(low + 1, len(s) - 1) + 1] - s[low + 1])::FLOAT * (place - low)::FLOAT)::FLOAT)::FLOAT AS value FROM p""")
def pieces_resample(spark: SparkSession, d: str) -> DataFrame:
    """Long streams resampled piece by piece, across their edges."""
    made = S.resampled_pieces(label_pieces(spark, d), FROM_RATE, TO_RATE)
    return made.select("stream_id", "first_sample", F.posexplode("samples").alias("k", "value")).select("stream_id", (F.col("first_sample") + F.col("k")).alias("sample_no"), "value")


@query(f"""WITH {STREAMS}, c AS (SELECT stream_id, s, unnest(range(0, ceil(len(s) / {PIECE})::BIGINT)) AS piece_no FROM streams), cut AS (SELECT *, s[piece_no * {PIECE} + 1:(piece_no + 1) * {PIECE}] AS x FROM c)
SELECT stream_id, piece_no, piece_no * {PIECE} AS first_sample, len(x)::BIGINT AS n_samples, x[1]::FLOAT AS first, x[-1]::FLOAT AS last, list_max(list_transform(x, lambda v: abs(v::DOUBLE))) AS peak FROM cut""")
def pieces_recut(spark: SparkSession, d: str) -> DataFrame:
    """Long streams cut anew into pieces of equal length."""
    cut = S.recut(label_pieces(spark, d), PIECE)
    peak = F.array_max(F.transform("samples", lambda v: F.abs(v.cast("double"))))
    return cut.select("stream_id", "piece_no", "first_sample", F.size("samples").cast("long").alias("n_samples"), F.get("samples", F.lit(0)).alias("first"), F.element_at("samples", -1).alias("last"), peak.alias("peak"))


@query(f"""WITH {STREAMS}, c AS (SELECT stream_id, s[801:2400] AS x FROM streams) SELECT stream_id, len(x)::BIGINT AS n_samples, list_max(list_transform(x, lambda v: abs(v::DOUBLE))) AS peak, true AS audible FROM c WHERE len(x) > 0""")
def pieces_stretch(spark: SparkSession, d: str) -> DataFrame:
    """A tenth of a second of each long stream from the 800th sample on, and its levels."""
    return S.levels(S.stretch(label_pieces(spark, d), F.lit(0.05), F.lit(0.1))).select("stream_id", "n_samples", "peak", "audible")


@query(f"""WITH {STREAMS} SELECT stream_id::VARCHAR AS stream_id, len(s)::BIGINT AS n_samples, ceil(len(s) / 1000)::BIGINT AS n_pieces, list_max(list_transform(s, lambda v: abs(v::DOUBLE))) AS peak FROM streams""")
def sound_files_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Long streams written as files of raw sound and read again in byte ranges."""
    folder = fresh_folder(spark, "sound")
    sound_files.write_sound(label_pieces(spark, d), folder)
    back = sound_files.read_sound(spark, folder, piece_samples=1000, task_bytes=40_000)
    loudest = S.levels(back, 1 << 40).select("stream_id", "peak")
    return S.lengths(back).join(loudest, "stream_id").select("stream_id", "n_samples", (F.col("last_piece") + 1).alias("n_pieces"), "peak")


@query("""SELECT vec_id::BIGINT AS stream_id, len(embedding)::BIGINT AS n_samples, coalesce(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 0) >= 0.35 AS audible FROM embeddings""")
def silent_streams(spark: SparkSession, d: str) -> DataFrame:
    """Sound of one bit, most of it silent, and whether it is audible."""
    pcm = derived.pcm(derived.table(spark, d, "embeddings")).select("stream_id", F.transform("samples", lambda x: F.when(F.abs(x.cast("double")) >= 0.35, F.signum(x)).otherwise(F.lit(0.0)).cast("float")).alias("samples"))
    return A.audible(pcm).select("stream_id", "n_samples", "audible")


@query(f"""SELECT key, CASE WHEN starts_with(key, 'video_markers.') AND length(value) > 4 THEN upper(value) ELSE value END AS value, 4 AS version FROM ({STORE}) WHERE NOT starts_with(key, 'gpt_prompt_input.') AND substr(key, -1) <> '7'
UNION ALL SELECT 'video_markers.' || doc_id || '.new', coalesce(lang, ''), 4 FROM documents WHERE source LIKE '%a%' AND substr(doc_id::VARCHAR || '.new', -1) <> '7'""")
def store_versions(spark: SparkSession, d: str) -> DataFrame:
    """The store as a table on disk: created, changed, purged of a prefix and of some keys, and read (K1 to K3)."""
    begun, docs = store_of(spark, d), derived.table(spark, d, "documents")
    table = KeyedTable(spark, fresh_folder(spark, "store"))
    table.create(begun, buckets=8)
    changed = begun.where("startswith(key, 'video_markers.') and length(value) > 4").select("key", F.upper("value").alias("value"), F.lit(2).alias("change_no"))
    added = docs.where("source like '%a%'").select(F.concat(F.lit("video_markers."), F.col("doc_id").cast("string"), F.lit(".new")).alias("key"), F.coalesce("lang", F.lit("")).alias("value"), F.lit(1).alias("change_no"))
    table.upsert(changed.withColumn("value", F.lit("lost")).withColumn("change_no", F.lit(1)).unionByName(changed).unionByName(added))
    table.purge(["gpt_prompt_input."])
    table.remove(table.read().where("endswith(key, '7')").select("key"))
    return table.read().withColumn("version", F.lit(table.manifest()["version"]))


def channels_of(spark: SparkSession, d: str, first_chars: int | None = None) -> DataFrame:
    """The channel of each language as one long video of segments; of these all that may begin within ``first_chars``
    characters of lines, which are no shorter than their texts, or all."""
    videos = derived.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.coalesce("lang", F.lit("")).alias("channel"))
    laid = T.channel_timeline(segments_of(spark, d), videos, first_chars=first_chars).join(segments_of(spark, d).select("video_id", "seg_no", "text"), ["video_id", "seg_no"])
    return laid.select(F.col("channel").alias("video_id"), (F.col("video_id") * (1 << 20) + F.col("seg_no")).alias("seg_no"), "start_sec", "end_sec", "text")


CHANNEL_SQL = f"""{SEGMENTS}, laid AS (SELECT coalesce(d.lang, '') AS channel, s.video_id * 1048576 + s.seg_no AS seg_no, s.text, s.end_sec - s.start_sec AS secs FROM segments s JOIN documents d ON d.doc_id = s.video_id),
timed AS (SELECT channel, seg_no, text, sum(secs) OVER w - secs AS start_sec, sum(secs) OVER w AS end_sec FROM laid WINDOW w AS (PARTITION BY channel ORDER BY seg_no))"""


@query(f"""WITH {CHANNEL_SQL}, shown AS (SELECT *, '[' || printf('%.2f', start_sec) || 's-' || printf('%.2f', end_sec) || 's] ' || text AS line FROM timed),
run AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY channel ORDER BY seg_no) AS total FROM shown)
SELECT channel, seg_no::BIGINT AS seg_no, total::BIGINT AS running_chars, total >= 60000 AS cut FROM run WHERE total - length(line) - 1 < 60000""")
def channel_budget(spark: SparkSession, d: str) -> DataFrame:
    """The beginning of each channel's transcript that fits into 60,000 characters, with the line that is cut."""
    kept = T.within_budget(channels_of(spark, d, T.MOST_CONTEXT_CHARS))
    return kept.select(F.col("video_id").alias("channel"), "seg_no", F.col("running_chars").cast("long").alias("running_chars"), "cut")


@query(f"""WITH {SEGMENTS}, o AS (SELECT doc_id AS video_id FROM documents), t AS (SELECT video_id, count(*) AS n, sum(length(text)) AS c, max(end_sec) - min(start_sec) AS s FROM segments GROUP BY 1)
SELECT video_id, coalesce(s, 0.0) AS selected_sec, coalesce(n, 0)::BIGINT AS n_segments, coalesce(c, 0)::BIGINT AS n_chars, CASE WHEN s >= 2400 THEN 'large_range_multiple_clips' WHEN s >= 600 THEN 'medium_range_one_or_more_clips' ELSE 'short_range_best_moment' END AS scope,
coalesce(s < 90 OR n < 8 OR c < 400, true) AS may_have_no_clip FROM o LEFT JOIN t USING (video_id)""")
def whole_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Scopes of whole videos, which reach all three."""
    s = segments_of(spark, d)
    none = s.select("video_id", F.lit(0).cast("long").alias("range_no"), "start_sec", "end_sec").where("false")
    overall = derived.table(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.lit(0.0).alias("range_start_sec"), F.lit(0.0).alias("range_end_sec"))
    return A.selected_duration(s, none, overall)


@query(f"""WITH log AS (SELECT event_id::BIGINT AS seq, user_id::BIGINT AS job_id, {STATES} AS state, (event_id % 101)::BIGINT AS progress FROM events), s AS (SELECT job_id, arg_max(state, seq) AS state, arg_max(progress, seq) AS progress FROM log GROUP BY 1),
b AS (SELECT *, job_id // 3 AS batch_id FROM s),
t AS (SELECT batch_id, floor(sum(CASE WHEN state IN ('succeeded', 'failed', 'canceled') THEN 100 ELSE progress END) / count(*))::BIGINT AS progress, count(*) AS n_jobs, count(*) FILTER (WHERE state IN ('succeeded', 'failed', 'canceled')) AS n_done,
count(*) FILTER (WHERE state = 'failed') AS n_failed, count(*) FILTER (WHERE state = 'canceled') AS n_canceled FROM b GROUP BY 1)
SELECT *, CASE WHEN n_done < n_jobs THEN 'running' WHEN n_canceled > 0 THEN 'canceled' WHEN n_failed > 0 THEN 'failed' ELSE 'success' END AS outcome FROM t""")
def batch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Progress and outcome of batches of three uploads, every outcome among them."""
    states = jobs.job_states(log_of(spark, d)).withColumn("batch_id", F.floor(F.col("job_id") / 3).cast("long"))
    return jobs.batch_outcome(states, ("batch_id",)).select("batch_id", "progress", "n_jobs", "n_done", "n_failed", "n_canceled", "outcome")
