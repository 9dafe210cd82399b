"""Upload jobs as a fold over their event log, in batch or as a stream.

Events are (seq, job_id, state, progress, message); states are pending, running, succeeded, failed
and canceled. The folds are aggregations with partial states, so a stream keeps one row per job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspan.functions.text import trimmed

FINISHED = ("succeeded", "failed", "canceled")


def job_states(events: DataFrame) -> DataFrame:
    """Per job its last state and progress, its last message that isn't blank, and its last event."""
    filled = F.when(trimmed("message") != "", F.col("message"))
    at = F.when(trimmed("message") != "", F.col("seq"))
    return events.groupBy("job_id").agg(F.max_by("state", "seq").alias("state"), F.max_by("progress", "seq").alias("progress"), F.max_by(filled, at).alias("message"), F.max("seq").alias("last_seq"))


def after_cancel(states: DataFrame) -> DataFrame:
    """States after a cancellation: pending jobs are canceled at once, running ones are signalled."""
    return states.withColumn("signalled", F.col("state") == "running").withColumn("state", F.when(F.col("state") == "pending", "canceled").otherwise(F.col("state")))


def batch_progress(states: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For all jobs, or for those of each batch that the columns ``by`` name: whole mean of the progress (finished
    jobs count as 100), the message of the last job that has one, and counts."""
    done = F.col("state").isin(*FINISHED)
    progress = F.when(done, 100).otherwise(F.col("progress"))
    return states.groupBy(*by).agg(
        F.floor(F.sum(progress) / F.count("*")).cast("long").alias("progress"),
        F.max_by(F.col("message"), F.when(F.col("message").isNotNull(), F.col("job_id"))).alias("message"),
        F.count("*").alias("n_jobs"), F.count_if(done).alias("n_done"), F.count_if(F.col("state") == "failed").alias("n_failed"), F.count_if(F.col("state") == "canceled").alias("n_canceled"),
    )


def batch_outcome(states: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For all jobs or by batch: running while a job isn't finished; then canceled, failed or success."""
    p = batch_progress(states, by)
    outcome = F.when(F.col("n_done") < F.col("n_jobs"), "running").when(F.col("n_canceled") > 0, "canceled").when(F.col("n_failed") > 0, "failed").otherwise("success")
    return p.withColumn("outcome", outcome)


def phase_progress(progress: Column | str, resampling: Column | str) -> Column:
    """Progress of an upload; after a cutting phase it fills the second half."""
    p = F.col(progress) if isinstance(progress, str) else progress
    r = F.col(resampling) if isinstance(resampling, str) else resampling
    return F.when(r, F.lit(50) + F.floor(p / 2)).otherwise(p).cast("long")


def accepted(paths: DataFrame, existing: DataFrame) -> DataFrame:
    """(job_id, path, state): jobs of existing files are pending, others failed from the start."""
    there = existing.select("path", F.lit("pending").alias("state")).distinct()
    return paths.join(there, "path", "left").select("job_id", "path", F.coalesce("state", F.lit("failed")).alias("state"))


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Job events from JSON files as they arrive."""
    return spark.readStream.schema("seq long, job_id long, state string, progress long, message string").json(folder)


def recording_stream(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """New recordings of a folder as they arrive: path, modified_at, size_bytes."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder)
    return found.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size_bytes"))
