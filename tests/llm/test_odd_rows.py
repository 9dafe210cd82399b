"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and extra
columns whose names clash with its own."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reelspan.llm import class_lm, decontaminate, html_text, licenses, ngram_join, packing, pii, quality, tiff, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
CLASH = "n_tokens string, n_bytes string, score string, key string, uid string, token string, prefix string, spans string, sequence_id string, page string, host string, place string, item_id string, component_id string"
LONG = "word " * 30_000 + "x" * 50_000


def odd(spark, empty=False):
    texts = [(None, None), (None, "alone here"), (1, ""), (1, ""), (2, LONG), (3, "the same four words in a row"), (4, "the same four words in a row"), (5, None), (6, " \n\t "), (7, "Ünïcödé 😀 texts too")]
    rows = [] if empty else [(i, t, *["?"] * 14) for i, t in texts]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASH}")


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(9, None, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, "the same four words in a row"), (2, "short one"), (3, None), (None, "x y z x y z")], "item_id long, text string")


PER_ROW = {
    "counts": lambda s, d: token_counts.count_tokens(d, PATH),
    "pii": lambda s, d: pii.detect(d),
    "redact": lambda s, d: pii.redact(d),
    "tiff": lambda s, d: tiff.page_digests(tiff.decode_pages(tiff.encode_pages(d), carry=("n_bytes",))),
    "quality": lambda s, d: quality.score(d, labels(s)),
    "lm": lambda s, d: class_lm.score(d),
    "join": lambda s, d: ngram_join.join(d),
    "html": lambda s, d: html_text.extract(d.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumnRenamed("host", "url")),
}
SOME_ROWS = {
    "pack": lambda s, d: packing.pack(d, PATH),
    "leaks": lambda s, d: decontaminate.contamination(d, benchmark(s)),
    "unleaked": lambda s, d: decontaminate.remove_leaks(d, benchmark(s)),
    "licenses": lambda s, d: licenses.scan_licenses(d),
    "good": lambda s, d: quality.keep_good(d, labels(s)),
    "distinct": lambda s, d: ngram_join.one_of_each(d),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each(spark, name):
    assert PER_ROW[name](spark, odd(spark)).count() == 10
    assert PER_ROW[name](spark, odd(spark, empty=True)).count() == 0


@pytest.mark.parametrize("name", SOME_ROWS)
def test_no_crash(spark, name):
    SOME_ROWS[name](spark, odd(spark)).collect()
    assert SOME_ROWS[name](spark, odd(spark, empty=True)).count() == 0


@pytest.mark.parametrize("run", [" ", "\n", "\t \n", "\u3000", "7", "a", "-", "\xa0"])
def test_long_runs_have_the_ids_of_the_library(run):
    """Runs of which the encoder's pattern would look for the end too deep, alone and beside words and special strings."""
    encoder, library = packing.Encoder(PATH), Tokenizer.from_file(PATH)
    long, some = run * (1_200_000 // len(run)), run * 5000
    for text in (long, f"a{long}b", f"{some}it's {some} x{some}", f"<|endoftext|>{some}<|endoftext|>{some}b\n", f"é{some}\x85"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_runs_are_packed(spark):
    d = spark.createDataFrame([(1, " " * 3_000_000), (2, "x" + "\n" * 1_500_000 + "y")], "doc_id long, text string")
    assert packing.pack(d, PATH).groupBy("doc_id").sum("length").count() == 2


def test_stated_results(spark):
    d = odd(spark)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(d, benchmark(spark)).collect()} == {(3, 1), (4, 1)}
    kept = decontaminate.remove_leaks(d, benchmark(spark))
    assert kept.count() == 8 and kept.columns == d.columns
    joined = {r["doc_id"]: r["component_id"] for r in ngram_join.join(d).collect() if r["doc_id"]}
    assert joined[4] == 3 and joined[1] == 1 and joined[5] == 5
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(d).collect() if r["doc_id"]) == [1, 1, 2, 3, 5, 6, 7]
    pieces = packing.pack(d, PATH).collect()
    assert sum(p["length"] for p in pieces if p["doc_id"] == 5) == 1
    assert quality.score(d, labels(spark).where("false")).where("score < 0.9").count() == 0
    assert class_lm.score(d).where("doc_id = 5").first()["n_tokens"] == 1
