"""The templates of documents with odd values, against the SQL."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from reelspan.plans import catalogue
from reelspan.plans import prompts as P

TEXTS = [None, "", " \n", " lead", "tail\r\n", "\n a\n b \n", "\x0ba\x0b", " a ", "x {{transcript}} y", "{{selected_range_transcript}}", "$1 \\1", "plain"]
LANGS = [None, "", "en", "pt", "EN", " en", "pt-br", "fr"]
SOURCES = [None, "", " ", "a  b", "\na\t\nb ", "\x0ba\x0b", "\x0b", " a　", "a  ", "{{issues}} {{named_references}}", "{{generated_opus_prompt}}", "OPUS_PROMPT: x", "src1"]
CHARS = [None, 0, -7, 59, 10**9]
IDS = [None, 0, 1, -1, -15, 2**62]


def test_odd_values_equal_sql(spark, tmp_path):
    plain = [(i, t, "en", "src1", 10) for i, t in enumerate(TEXTS)] + [(i + 100, "t", x, "src1", 10) for i, x in enumerate(LANGS)] + [(i + 200, "t", "en", s, 10) for i, s in enumerate(SOURCES)]
    odd = plain + [(i + 300, "t", "en", "src1", c) for i, c in enumerate(CHARS)] + [(i, "t", "en", "src1", 10) for i in IDS] + [(400 + i, t, "en", s, 10) for i, (t, s) in enumerate((t, s) for t in TEXTS for s in SOURCES)]
    shape = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.table([list(c) for c in zip(*odd)], schema=shape), tmp_path / "documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    theirs = sorted(db.sql(catalogue.SQL["filled_templates"]).fetchall(), key=repr)
    ours = sorted((tuple(r) for r in catalogue.QUERIES["filled_templates"](spark, str(tmp_path)).select("video_id", "input", "repair").collect()), key=repr)
    assert [x for x in ours if x not in theirs] == [] and ours == theirs


def test_a_large_value_is_put_in(spark):
    large = spark.range(1).select(F.repeat(F.lit("x"), 140_000_000).alias("x"))
    assert large.select(F.length(P.filled(F.lit("a {{x}} {{none}}{{y}}b{{y}}"), {"x": F.col("x"), "y": F.lit("\\$1")}))).first()[0] == 140_000_000 + 18
    assert spark.range(1).select(P.filled(F.lit("{{y}}a{{y}}{{z}}"), {"y": F.lit("$1\\"), "z": F.lit(None).cast("string")})).first()[0] == "$1\\a$1\\"
