"""Sound in pieces and in files, against whole arrays."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelspan.operators import aggregates as A
from reelspan.operators import sound as S
from reelspan.sources import files
from reelspan.sources import sound_files as SF

PCM = "stream_id long, samples array<float>"


def streams(spark, lengths=(1, 2, 7, 64, 1000, 4097)):
    rng = random.Random(4)
    return spark.createDataFrame([(n, [struct.unpack("f", struct.pack("f", rng.uniform(-1, 1)))[0] for _ in range(n)]) for n in lengths], PCM)


def whole(pieces):
    """stream -> samples in order; the pieces leave no gap."""
    out = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["stream_id"], r["first_sample"])):
        held = out.setdefault(r["stream_id"], [])
        assert r["first_sample"] == len(held) and r["samples"]
        held += r["samples"]
    return out


@pytest.mark.parametrize("size", [1, 5, 64, 5000])
@pytest.mark.parametrize("rates", [(44_100, 16_000), (16_000, 44_100), (8_000, 16_000), (48_000, 16_000), (16_000, 16_000), (44_101, 7)])
def test_resampling_in_pieces_is_bit_equal(spark, size, rates):
    pcm = streams(spark, (1, 2, 7, 64, 1000))
    want = {r["stream_id"]: r["samples"] for r in A.resampled(pcm, *rates).collect()}
    assert whole(S.resampled_pieces(S.pieces_of(pcm, size), *rates)) == want


def test_recutting_and_stretches(spark):
    pcm = streams(spark)
    ragged = S.resampled_pieces(S.pieces_of(pcm, 7), 44_100, 16_000)
    again = S.recut(ragged, 100)
    assert whole(again) == whole(ragged)
    assert {r["piece_no"] for r in again.where("stream_id = 4097").collect()} == set(range(15)) and again.where("size(samples) > 100").isEmpty()
    for start, length in ((0.0, 0.001), (0.002, 0.05), (-1.0, 0.01), (9.0, 1.0), (0.0, 0.0)):
        want = {r["stream_id"]: r["samples"] for r in files.sound_range(pcm, F.lit(start), F.lit(length)).collect() if r["samples"]}
        assert whole(S.stretch(S.pieces_of(pcm, 10), F.lit(start), F.lit(length))) == want


def test_levels(spark):
    bad = spark.createDataFrame([(-1, [float("nan"), 0.5, float("-inf")]), (-2, [0.0] * 30), (-3, []), (-4, None)], PCM)
    pcm = streams(spark).union(bad)
    want = {r["stream_id"]: r for r in A.audible(pcm).collect()}
    got = {r["stream_id"]: r for r in S.levels(S.pieces_of(pcm, 16)).collect()}
    assert set(got) == set(want) - {-3, -4}  # without samples there are no pieces
    for k, r in got.items():
        assert (r["n_samples"], r["peak"], r["audible"]) == (want[k]["n_samples"], want[k]["peak"], want[k]["audible"]) and abs(r["rms"] - want[k]["rms"]) < 1e-12
    assert S.levels(S.pieces_of(pcm, 16), 20).where("stream_id = 64").first()["n_samples"] == 20


def test_placing_parts_of_unequal_length(spark):
    parts = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [3.0]), (1, 2, [4.0] * 5), (2, 0, [9.0])], "stream_id long, piece_no long, samples array<float>")
    assert whole(S.placed(parts)) == {1: [1.0, 2.0, 3.0] + [4.0] * 5, 2: [9.0]}


def test_files_are_read_in_ranges_by_many_tasks(spark, tmp_path):
    values = np.random.default_rng(1).uniform(-1, 1, 3_000_001).astype("<f4")
    (tmp_path / "long.f32").write_bytes(values.tobytes() + b"\x01\x02")  # and a trailing part of a sample
    (tmp_path / "short.f32").write_bytes(values[:5].tobytes())
    (tmp_path / "empty.f32").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"abcd")
    df = SF.read_sound(spark, str(tmp_path), task_bytes=2_000_000)
    assert df.rdd.getNumPartitions() == 11
    out = {r["stream_id"]: r for r in S.levels(df, 1 << 40).join(S.lengths(df), "stream_id").collect()}
    assert set(out) == {"long", "short"} and out["long"][1] == 3_000_001 and out["long"]["peak"] == float(np.abs(values).max())
    one = SF.read_sound(spark, f"file://{tmp_path}/short.f32", piece_samples=2)
    assert [(r["piece_no"], r["first_sample"], len(r["samples"])) for r in one.orderBy("piece_no").collect()] == [(0, 0, 2), (1, 2, 2), (2, 4, 1)]
    assert whole(one) == {"short": values[:5].tolist()}
    with pytest.raises(Exception, match="nowhere"):
        SF.read_sound(spark, str(tmp_path / "nowhere")).count()


def test_written_files_are_read_back(spark, tmp_path):
    pcm = streams(spark)
    SF.write_sound(S.pieces_of(pcm, 50).repartition(6), f"file://{tmp_path}/out")
    back = whole(SF.read_sound(spark, f"{tmp_path}/out", piece_samples=33))
    assert back == {str(r["stream_id"]): r["samples"] for r in pcm.collect()}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"{n}.f32" for n in (1, 2, 7, 64, 1000, 4097))
    with pytest.raises(Exception, match="no samples from 10 to 20"):
        SF.write_sound(S.pieces_of(pcm, 10).where("piece_no <> 1"), f"{tmp_path}/gap")
