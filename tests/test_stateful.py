"""Streams with state against the batch folds over all that came in."""

import json
import os
import random
from datetime import datetime, timedelta, timezone

import pytest

from reelspan.sources import files
from reelspan.streaming import jobs, stateful

BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENTS = "seq long, job_id long, state string, progress long, message string, at timestamp"
RECORDER = "session_id long, event_no long, kind string, at timestamp"


@pytest.fixture(autouse=True)
def state_store(spark):
    stateful.use_state_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def feed(spark, folder, schema, batches):
    folder.mkdir()
    for i, rows in enumerate(batches):
        path = folder / f"{i:03d}.json"
        path.write_text("\n".join(json.dumps({k: v.isoformat() if isinstance(v, datetime) else v for k, v in r.items()}) for r in rows))
        os.utime(path, (1_700_000_000 + 10 * i,) * 2)  # files are read in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def run(df, mode, name, tmp_path):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return query


def test_jobs_out_of_order_and_repeated(spark, tmp_path):
    rng, rows = random.Random(3), []
    for job in range(4):
        for k, (state, message) in enumerate([("pending", ""), ("running", "half"), ("running", None), ("succeeded" if job % 2 else "running", " ")]):
            rows.append({"seq": job * 10 + k, "job_id": job, "state": state, "progress": k * 30, "message": message, "at": BEGIN + timedelta(seconds=job * 5 + k)})
    mixed = rows + rng.sample(rows, 6)
    rng.shuffle(mixed)
    late = {"seq": 99, "job_id": 50, "state": "pending", "progress": 0, "message": "end", "at": BEGIN + timedelta(hours=2)}
    stream = feed(spark, tmp_path / "in", EVENTS, [mixed[:8], mixed[8:15], mixed[15:], [late], [{**late, "seq": 100, "at": BEGIN + timedelta(hours=3)}]])
    query = run(stateful.job_updates(stream), "update", "job_updates", tmp_path)
    want = jobs.job_states(spark.createDataFrame(rows, EVENTS)).where("job_id < 50")
    columns = ("job_id", "state", "progress", "message", "last_seq")
    last = {}
    for r in spark.table("job_updates").collect():
        last[r["job_id"]] = tuple(r[c] for c in columns)  # the sink keeps the order of batches
    assert sorted(v for k, v in last.items() if k < 50) == sorted(tuple(r[c] for c in columns) for r in want.collect())
    held = sum(p["numRowsTotal"] for p in query.lastProgress["stateOperators"])
    whole = sum(p["numRowsTotal"] for p in query.recentProgress[2]["stateOperators"])
    assert held < whole  # finished jobs have left the state


def test_recordings_paired_on_a_stream(spark, tmp_path):
    rng, rows = random.Random(5), []
    for session in range(3):
        at = BEGIN
        for number in range(14):
            at += timedelta(seconds=rng.randrange(1, 40))
            rows.append({"session_id": session, "event_no": number, "kind": rng.choice(["start", "stop", "start", "stop", "pause"]), "at": at})
    mixed = rows + rows[:5]
    rng.shuffle(mixed)
    ends = [[{"session_id": 9, "event_no": k, "kind": "stop", "at": BEGIN + timedelta(hours=30 * (k + 1))}] for k in range(3)]
    stream = feed(spark, tmp_path / "in", RECORDER, [mixed[:15], mixed[15:30], mixed[30:], *ends])
    query = run(stateful.recording_windows(stream), "append", "recording_windows", tmp_path)
    want = files.recording_windows(spark.createDataFrame(rows, RECORDER))
    columns = ("session_id", "event_no", "start_at", "end_at")
    assert sorted(tuple(r[c] for c in columns) for r in spark.table("recording_windows").collect()) == sorted(tuple(r[c] for c in columns) for r in want.collect())
    assert want.count() > 5
    assert sum(p["numRowsTotal"] for p in query.lastProgress["stateOperators"]) <= 4  # starts without a stop have left it too
