"""Dialog tables (M1-M5) and sources / sinks (A1-A13, N1, streaming)."""

import json
import os

import pandas as pd
from pyspark.sql import functions as F

from causeway.operators import dialog as D
from causeway.sources import io


def _turns(spark, convs):
    rows = [(cid, i, role, text) for cid, msgs in convs.items() for i, (role, text) in enumerate(msgs)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def test_role_validation(spark):
    t = _turns(spark, {1: [("user", "a"), ("assistant", "b"), ("user", "c")],
                       2: [("user", "a"), ("user", "b")],
                       3: [("system", "s"), ("user", "u")],
                       4: [("user", "a"), ("assistant", "b")]})
    got = {r.conv_id: r.valid for r in D.validate_roles(t).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_inst_rendering_with_system(spark):
    t = _turns(spark, {1: [("system", "S"), ("user", "U")]})
    r = D.render_inst(t).collect()[0]
    assert r.prompt == "[INST] <<SYS>>\nS\n<</SYS>>\n\nU [/INST]"
    t = _turns(spark, {2: [("user", " a "), ("assistant", "b"), ("user", "c")]})
    assert D.render_inst(t).collect()[0].prompt == "[INST] a [/INST] b [INST] c [/INST]"


def test_header_rendering_order(spark):
    t = _turns(spark, {1: [("system", "S"), ("user", "U")]})
    r = D.render_header(t).collect()[0].prompt
    assert r == ("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nS<|eot_id|>"
                 "<|start_header_id|>user<|end_header_id|>\n\nU<|eot_id|>"
                 "<|start_header_id|>assistant<|end_header_id|>\n\n")


def test_tag_screen(spark):
    t = _turns(spark, {1: [("user", "hi [INST] x")], 2: [("user", "fine")]})
    assert {r.conv_id: r.unsafe for r in D.screen_tags(t).collect()} == {1: True, 2: False}


def test_archive_scan_counts_bad_lines(spark, tmp_path):
    p = tmp_path / "arch.jsonl"
    good = {"subreddit": "m", "body": "x", "score": 1, "created_utc": 5, "permalink": "/r/m/c/a/s/d/", "author": "a"}
    p.write_text(json.dumps(good) + "\n{not json\n" + json.dumps(good) + "\n")
    df = io.read_archive(spark, str(p), io.COMMENT_SCHEMA)
    c = io.bad_line_counts(df).collect()[0]
    assert (c.good, c.bad) == (2, 1)
    assert io.good_lines(df).count() == 2


def test_array_csv_and_resume(spark, tmp_path):
    csv = tmp_path / "probs.csv"
    csv.write_text('unit_id,probs\n1,"[0.1 0.2\n 0.7]"\n2,"[0.5 0.5]"\n')
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    schema = StructType([StructField("unit_id", LongType()), StructField("probs", StringType())])
    df = io.read_array_csv(spark, str(csv), schema, ["probs"])
    got = {r.unit_id: r.probs for r in df.collect()}
    assert got == {1: [0.1, 0.2, 0.7], 2: [0.5, 0.5]}
    out = str(tmp_path / "done")
    io.write_stage(df.where("unit_id = 1"), out, partition_by=())
    todo = io.todo(df, spark.read.parquet(out), "unit_id")
    assert [r.unit_id for r in todo.collect()] == [2]


def test_batch_scorer_scores_every_row(spark):
    df = spark.range(0, 103).select(F.col("id").alias("unit_id"), F.lit("a b c").alias("text"))

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"unit_id": pdf["unit_id"], "n": pdf["text"].str.count(r"\S+").astype("int64")})
    out = io.score(df, fn, "unit_id long, n long", batch_size=10)
    assert out.count() == 103 and out.agg(F.sum("n")).collect()[0][0] == 309


def test_template_and_model_roundtrip(spark, tmp_path):
    p = tmp_path / "tpl.txt"
    p.write_text("line one\nline two\n")
    assert io.read_template(spark, str(p)).collect()[0].template == "line one\nline two\n"


def test_streaming_curation(spark, tmp_path):
    from causeway.streaming.curate import curated_stream, start_curation
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"subreddit": "m", "body": "this is a perfectly fine comment with enough words in it", "score": 1,
             "created_utc": 10, "permalink": f"/r/m/comments/a/s/{i}/", "author": "ann"} for i in range(3)]
    rows.append({"subreddit": "m", "body": "[deleted]", "score": 1, "created_utc": 10, "permalink": "/x/", "author": "b"})
    (src / "part-0.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    s = curated_stream(spark, str(src), io.COMMENT_SCHEMA, "body", is_comment=True)
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = start_curation(s, out, ck, key="permalink")
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 3
    assert os.path.isdir(ck)


def test_streaming_resume_is_idempotent(spark, tmp_path):
    from causeway.streaming.curate import curated_stream, start_curation
    src = tmp_path / "in"
    src.mkdir()
    row = {"subreddit": "m", "body": "this is a perfectly fine comment with enough words in it", "score": 1,
           "created_utc": 10, "author": "ann"}
    (src / "a.json").write_text(json.dumps({**row, "permalink": "/p/1/"}) + "\n")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    start_curation(curated_stream(spark, str(src), io.COMMENT_SCHEMA, "body", True), out, ck).awaitTermination(120)
    # a new file repeats an already committed key and adds one new key
    (src / "b.json").write_text(json.dumps({**row, "permalink": "/p/1/"}) + "\n" +
                                json.dumps({**row, "permalink": "/p/2/"}) + "\n")
    start_curation(curated_stream(spark, str(src), io.COMMENT_SCHEMA, "body", True), out, ck).awaitTermination(120)
    got = sorted(r.permalink for r in spark.read.parquet(out).collect())
    assert got == ["/p/1/", "/p/2/"]


def test_archive_conversion_and_result_csv(spark, tmp_path):
    p = tmp_path / "arch.jsonl"
    good = {"subreddit": "m", "body": "x y", "score": 1, "created_utc": 5, "permalink": "/r/m/c/a/s/d/", "author": "a"}
    p.write_text("\n".join(json.dumps({**good, "score": i}) for i in range(4)) + "\n{broken\n")
    df = io.good_lines(io.read_archive(spark, str(p), io.COMMENT_SCHEMA))
    out = str(tmp_path / "arch_parquet")
    io.convert_archive(df, out)                                                  # A3
    assert sorted(r.score for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3]
    res = spark.createDataFrame([("ATE_mean", 0.1), ("ATE_std_dev", 0.02)], "metric string, ipw_eval500 double")
    csv = str(tmp_path / "results")
    io.write_stage(res, csv, partition_by=(), fmt="csv", mode="overwrite")      # A13
    back = spark.read.option("header", True).csv(csv).collect()
    assert sorted((r.metric, float(r.ipw_eval500)) for r in back) == [("ATE_mean", 0.1), ("ATE_std_dev", 0.02)]
