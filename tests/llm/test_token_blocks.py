"""Token blocks: exact round trips, ids equal to the library's, and failed tasks that leave no trace."""

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelspan.llm import token_blocks
from reelspan.llm.common import Scratch

WORD = public_tokenizers.path("word_bpe_49k.json")
CLASH = "start string, n_tokens string, ids string, h string, row string"


def library(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: [*tokenizer.encode(text, add_special_tokens=False).ids, 1]


def expected(rows, path=WORD):
    at, out, ids_of = 0, [], library(path)
    for doc, text in rows:
        ids = ids_of(text or "")
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_whole_table_equals_the_library(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert sorted(map(tuple, token_blocks.round_trip(docs, WORD).collect())) == expected(rows)


@pytest.mark.parametrize("ids", [
    [], [0], [2**32 - 1], [7] * 5000, list(range(3000)), [5] * 1000 + [2**32 - 1] * 24, [*[3] * 1023, 2**31], [0, 2**32 - 1] * 700,
    [random.Random(1).randrange(50_000) for _ in range(10_000)], [min(49_000, int(random.Random(i).paretovariate(0.4))) for i in range(4097)],
])
def test_blocks_round_trip(ids):
    values = np.array(ids, "<u4")
    blocks = token_blocks.pack(values)
    assert [len(token_blocks.unpack(b)) for b in blocks] == [min(1024, len(ids) - i) for i in range(0, len(ids), 1024)]
    assert b"".join(token_blocks.unpack(b).tobytes() for b in blocks) == values.tobytes()


def test_outliers_go_to_the_exceptions():
    rare = np.array([*[9] * 1000, *[40_000] * 24], "<u4")
    block = token_blocks.pack(rare)[0]
    _, n, width, exceptions = token_blocks.HEAD.unpack_from(block)
    assert (n, width, exceptions) == (1024, 0, 24) and len(block) < 200
    dense = token_blocks.pack(np.random.default_rng(2).integers(0, 2**15, 1024).astype("<u4"))[0]
    assert token_blocks.HEAD.unpack_from(dense)[2:] == (15, 0)


def test_words_that_are_remembered_have_the_ids_of_whole_texts():
    rng, encoder, ids_of = random.Random(5), token_blocks.Encoder(WORD), library(WORD)
    texts = ["", " ", "It's  the DOG'S\tday, they'll\x1cgo\x85on　x", "<|endoftext|>a <|startoftext|> b<|endof text|>", "Ünï H̱ ẖ KK İx ΑΣ Σ", "日本語 テキスト", "½²3 ①", "a" * 20_000, "1," * 5_000, " " * 300_000, "́a é ́"]
    texts += [w + m for w in ("Straße", "»é", "éa's", "é", "ça1") for m in (",***", "'s", "'S.", "'", "»", "...», a", "<|", "!")]
    texts += ["".join(rng.choice("abT '\n\t.,é1İ́😀 <|\x1f\xa0") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["".join(chr(rng.choice([rng.randrange(256), 32, 39, 115, 108])) for _ in range(60)) for _ in range(600)] + [f"a{chr(c)}b{chr(c)} '{chr(c)}" for c in range(256)]
    encoder.pieces.limit = 500
    assert encoder.by_word
    got = encoder.encode(texts) + encoder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids_of(t)[:-1] for t in texts] * 2
    other = token_blocks.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    whole = library(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_word and [np.frombuffer(x, "<u4").tolist() for x in other.encode(texts[:200])] == [whole(t)[:-1] for t in texts[:200]]


def odd(spark, rows):
    return spark.createDataFrame([(i, t, *"?????") for i, t in rows], f"doc_id long, text string, {CLASH}")


def test_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and keys, clashing columns, an empty table."""
    rows = [(None, "no key"), (None, None), (-5, "x"), (3, "twice"), (3, "twice"), (3, "thrice"), (4, ""), (5, None), (6, "long words " * 50_000), (2**62, "end")]
    got = token_blocks.round_trip(odd(spark, rows).repartition(3), WORD).collect()
    lengths = lambda rows: sorted((str(r[0]), r[2], r[3]) for r in rows)
    assert lengths(got) == lengths(expected(rows))
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in by_start] == sorted((r[0] for r in rows), key=lambda d: -(2**63) if d is None else d)
    end = 0
    for r in by_start:
        assert r["start"] == end
        end += r["n_tokens"]
    assert token_blocks.round_trip(odd(spark, []), WORD).collect() == []


def test_files_stretches_and_ids(spark, small):
    """Small files and small stretches give the same rows; the ids come back; ranges are files in order."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    folder = Scratch(spark, "blocks").base
    spark.dataSource.register(token_blocks.TokenBlocks)
    ordered = docs.select("doc_id", "text").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")
    ordered.write.format("token_blocks").mode("append").option("tokenizer", WORD).option("file_ids", "5000").save(folder)
    want = expected(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    read = spark.read.format("token_blocks").option("ids", "true").option("read_ids", "700").load(folder)
    got = sorted(read.collect())
    assert [tuple(r)[:4] for r in got] == want and all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"] for r in got)
    where, path = token_blocks.file_system(folder)
    with where.open_input_stream(f"{path}/{token_blocks.INDEX}") as f:
        index = json.loads(f.read())
    assert len(index["files"]) > 3 and read.rdd.getNumPartitions() > len(index["files"])
    assert index["ids"] == sum(f["ids"] for f in index["files"]) == sum(w[2] for w in want)


def test_a_failed_write_leaves_nothing_readable(spark):
    folder = Scratch(spark, "blocks").base
    spark.dataSource.register(token_blocks.TokenBlocks)
    bad = spark.range(4, numPartitions=4).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 3, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).cast("binary").alias("ids"))
    with pytest.raises(Exception, match="no"):
        bad.write.format("token_blocks").mode("append").save(folder)
    where, path = token_blocks.file_system(folder)
    assert where.get_file_info(f"{path}/{token_blocks.INDEX}").type.name == "NotFound"


def test_ids_of_other_encoders_are_written_as_they_are(spark):
    folder = Scratch(spark, "blocks").base
    spark.dataSource.register(token_blocks.TokenBlocks)
    ids = {2: [7] * 3000, 5: [], 9: [2**32 - 1, 0], None: [1]}
    rows = [(d, bytearray(np.array(x, "<u4").tobytes())) for d, x in sorted(ids.items(), key=lambda x: x[0] or -1)]
    spark.createDataFrame(rows, "doc_id long, ids binary").coalesce(1).write.format("token_blocks").mode("append").save(folder)
    got = token_blocks.read_ids(spark, folder, ids=True).orderBy("start", "n_tokens").collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in got} == ids and [r["start"] for r in got] == [0, 1, 3001, 3001]
