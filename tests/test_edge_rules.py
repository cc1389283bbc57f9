"""Edge rules: forum-keyed threads, NULL groups, labels outside a study, committed folders."""

import os

import pytest
from pyspark.sql import functions as F

from causeway.operators import discretize, features, grid, sampling, thread
from causeway.sources import io
from causeway.spec import BOTOX, CLINICAL, EMAIL, ERENUMAB, STUDIES, TIRZEPATIDE
from causeway.streaming.curate import append_new

SUB = "sub_id {0}, thread_key string, subreddit string, title string, selftext string, score int, created_utc long, permalink string, author string"
COM = "seq long, thread_key string, subreddit string, body string, score int, created_utc long, permalink string, author string"


@pytest.mark.parametrize("kind, ids", [("string", ["a", "b", "c"]), ("long", [2 ** 62, -2 ** 62, 5])])
def test_stitch_keeps_forums_apart_for_any_id(spark, kind, ids):
    subs = spark.createDataFrame([(ids[0], "help", "keto", "t", "k", 1, 0, "p", "ann"), (ids[1], "help", "migraine", "t", "m", 1, 0, "p", "bob"),
                                  (ids[2], "help", "keto", "t", "k2", 1, 0, "p", "eve")], SUB.format(kind))
    coms = spark.createDataFrame([(1, "help", "keto", "first", 1, 0, "p", "ann"), (2, "help", "migraine", "second", 1, 0, "p", "bob"),
                                  (3, "help", None, "third", 1, 0, "p", "bob"), (4, "help", "keto", "fourth", 1, 0, "p", None)], COM)
    got = {(r.sub_id, r.seq, r.subreddit, r.post, tuple(r.author_replies)) for r in thread.stitch(subs, coms).collect()}
    folded = lambda own, reply: own + thread.REPLY_HEADER + thread.REPLY_PREFIX + reply
    assert got == {(ids[0], None, "keto", folded("k", "first"), ("first",)), (ids[1], None, "migraine", folded("m", "second"), ("second",)),
                   (ids[2], None, "keto", "k2", ()), (ids[2], 1, "keto", "first", ()), (ids[0], 4, "keto", "fourth", ()),
                   (ids[2], 4, "keto", "fourth", ())}


def test_null_group_is_a_group(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 50, "g").alias("g"), (F.col("id") / 100).alias("u"))
    got = sampling.take_smallest(df, ["g"], 5, "u", "id").select("g", "id").collect()
    assert sorted(r.id for r in got if r.g == "g") == list(range(5)) and sorted(r.id for r in got if r.g is None) == list(range(50, 55))


def test_aliases_encode_and_published_labels_decode(spark):
    df = spark.createDataFrame([("US",), ("United Kingdom",), ("UK",), ("Atlantis",), (None,)], "country string")
    got = discretize.encode(df, BOTOX)
    assert [r.country for r in got.collect()] == [0, 4, 4, None, None]
    assert [r.country for r in discretize.decode(got, BOTOX).collect()] == ["United States", "United Kingdom", "United Kingdom", None, None]


def test_only_missing_answers_are_imputed(spark):
    df = spark.createDataFrame([(1, "Suburban area", "Pigeon", "maybe"), (2, "Unknown", None, "unknown"), (3, "Rural", "Web", "Yes")],
                               "unit_id long, zip_code string, channel string, newbie string")
    a, b, c = discretize.discretize_email(df).orderBy("unit_id").collect()
    assert (a.zip_code, a.channel, a.newbie) == (None, None, None)
    assert b.zip_code in range(3) and b.channel in range(3) and b.newbie in range(2)
    assert (c.zip_code, c.channel, c.newbie) == (1, 1, 1)


def test_every_option_field_has_a_question(spark):
    for name in CLINICAL:
        spec = STUDIES[name]
        missing = [f for f in spec.options if f not in spec.questions]
        assert missing == (["country"] if name == "liraglutide" else []), name      # none is published for it
    assert TIRZEPATIDE.questions["target_achieved"] == "Did the user lose 5 or more percent of their initial weight?"
    assert ERENUMAB.questions["age"] == "Is the user's age greater than 32 years?"
    with pytest.raises(KeyError):
        grid.question(EMAIL, "age")


def test_transaction_ids_shared_by_two_clients(spark):
    lines = spark.createDataFrame([("a", "t", 1, 10.0, 1.0, 2), ("b", "t", 2, 30.0, 3.0, 5)],
                                  "client_id string, transaction_id string, o int, purchase_sum double, regular_points_received double, product_quantity int")
    clients = spark.createDataFrame([("a",), ("b",)], "client_id string")
    got = {r.client_id: (r.avg_purchase, r.avg_product_quantity, r.num_transactions)
           for r in features.client_features(lines, None, clients, "o").collect()}
    assert got == {"a": (10.0, 2.0, 1), "b": (30.0, 5.0, 1)}


def test_uncommitted_folder_is_no_cache(spark, tmp_path):
    path = tmp_path / "split"
    os.makedirs(path)
    make = lambda: spark.createDataFrame([(1, "train")], "unit_id long, split string")
    assert not io.committed(spark, str(path)) and io.read_or_compute(spark, str(path), make).count() == 1
    assert io.committed(spark, str(path))


def test_scorer_must_return_every_row(spark):
    with pytest.raises(Exception, match="returned 0 rows"):
        io.score(spark.range(3), lambda b: b.iloc[:0], "id long", batch_size=2).collect()


def test_streaming_sink_appends_a_key_once(spark, tmp_path):
    write = append_new(str(tmp_path / "out"), "k")
    write(spark.createDataFrame([(1,), (1,), (2,)], "k long"), 0)
    write(spark.createDataFrame([(2,), (3,), (3,)], "k long"), 1)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3]


def test_trial_units_do_not_depend_on_the_split_of_the_file(spark, tmp_path):
    head = "recency,history_segment,history,mens,womens,zip_code,newbie,channel,segment,visit,conversion,spend\n"
    rows = [f"{i % 5},1) $0 - $100,{i % 3}.5,1,0,Rural,0,Web,No E-Mail,0,0,0\n" for i in range(40)]
    ids = []
    for n, part in (("one", [rows]), ("two", [rows[25:], rows[:25]])):
        os.makedirs(tmp_path / n)
        for k, some in enumerate(part):
            (tmp_path / n / f"{k}.csv").write_text(head + "".join(some))
        ids.append(sorted(r.unit_id for r in io.read_email_trial(spark, str(tmp_path / n)).select("unit_id").collect()))
    assert ids[0] == ids[1] and len(set(ids[0])) == 40
