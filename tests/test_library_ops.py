"""Library operators that no registered query needs on its own: split cache (A5),
model save/load (A12), id subsets (B21), rendering prep (C28), role projection (C29),
first-n (G1), system/user pairs (M6), lineage cuts."""

import pytest
from pyspark.sql import functions as F

from causeway.operators import baseline, clean, dialog, discretize, sampling
from causeway.session import checkpoint_dir, cut_lineage
from causeway.sources import io
from causeway.spec import EMAIL, RETAIL


def test_split_cache_computes_once(spark, tmp_path):
    path = str(tmp_path / "split")
    calls = []

    def compute():
        calls.append(1)
        return spark.range(10).select(F.col("id").alias("unit_id"),
                                      F.when(F.col("id") < 6, "train").otherwise("val").alias("split"))
    a = io.read_or_compute(spark, path, compute)
    b = io.read_or_compute(spark, path, compute)
    assert len(calls) == 1 and a.count() == b.count() == 10
    assert {r.split for r in b.select("split").distinct().collect()} == {"train", "val"}


def test_vocabulary_roundtrip(spark, tmp_path):
    """A fitted vocabulary is a table; read back it encodes alike."""
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "beta gamma")], "doc_id long, text string")
    vocab = baseline.vocabulary(docs, "text")
    baseline.save_models(vocab, str(tmp_path / "vocab"))
    back = baseline.load_models(spark, str(tmp_path / "vocab"))
    rows = lambda v: sorted(map(tuple, baseline.bag_of_words(docs, v, "doc_id", "text").collect()))
    assert rows(back) == rows(vocab) and sum(r[2] for r in rows(back)) == 5


def test_subset_first_n_roles(spark):
    df = spark.range(20).select(F.col("id").alias("unit_id"), (F.col("id") % 2).alias("email_type"),
                                (F.col("id") % 3).alias("visit"), F.lit(1).alias("womens"), F.lit(0).alias("newbie"))
    ids = spark.createDataFrame([(3,), (5,), (99,)], "unit_id long")
    assert sorted(r.unit_id for r in clean.subset(df, ids).collect()) == [3, 5]
    assert [r.unit_id for r in clean.first_n(df.repartition(4), 3).collect()] == [0, 1, 2]
    assert EMAIL.roles(enum=True) == ["womens", "newbie", "email_type", "visit"]
    assert EMAIL.select_roles(df, enum=True, extra=("unit_id",)).columns == ["unit_id", "womens", "newbie",
                                                                             "email_type", "visit"]


def test_round_and_label(spark):
    df = spark.createDataFrame([(263.6, 1, 0)], "avg_purchase double, purchase int, sms_communication int")
    r = sampling.round_and_label(df, ["avg_purchase"], {"purchase": {0: "No", 1: "Yes"},
                                                        "sms_communication": {0: "No", 1: "Yes"}}).collect()[0]
    assert (r.avg_purchase, r.purchase, r.sms_communication) == ("264", "Yes", "No")
    assert RETAIL.descriptions["purchase"].startswith("You made another purchase")


def test_system_user_pair(spark):
    df = spark.createDataFrame([("a post",)], "post string")
    r = dialog.system_user_pair(df, "sys", "post").collect()[0].dialog
    assert [(m.role, m.content) for m in r] == [("system", "sys"), ("user", "a post")]


def test_lineage_cut_uses_session_folder(spark):
    d = checkpoint_dir(spark)
    assert d and spark.conf.get("spark.checkpoint.dir") == d
    df = cut_lineage(spark.range(5).withColumn("x", F.col("id") * 2))
    assert df.agg(F.sum("x")).collect()[0][0] == 20


def test_encode_decode_frames_with_prefix(spark):
    from causeway.operators import discretize
    df = spark.createDataFrame([("Rural area", "Web", "Yes")], "sample_zip_code string, sample_channel string, sample_visit string")
    enc = discretize.encode(df, EMAIL, prefix="sample_").collect()[0]
    assert (enc.sample_zip_code, enc.sample_channel, enc.sample_visit) == (1, 1, 1)
    dec = discretize.decode(discretize.encode(df, EMAIL, prefix="sample_"), EMAIL, prefix="sample_").collect()[0]
    assert (dec.sample_zip_code, dec.sample_channel, dec.sample_visit) == ("Rural area", "Web", "Yes")


def test_marginal_array_and_table_forms_agree(spark):
    import numpy as np
    from causeway.functions import arrays as A
    from causeway.operators import grid
    rng = np.random.default_rng(3)
    arrs = rng.dirichlet(np.ones(12), size=5)
    df = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(arrs)], "u bigint, p array<double>")
    shape, keep = [2, 3, 2], [0, 2]
    arr = {r.u: r.m for r in df.select("u", A.marginal("p", shape, keep).alias("m")).collect()}
    tab = {}
    for r in grid.marginalise(df, "p", shape, keep, "u").collect():
        tab.setdefault(r.u, {})[r.cell] = r.p
    for u, a in enumerate(arrs):
        want = a.reshape(shape).sum(axis=1).reshape(-1)
        assert np.allclose(arr[u], want) and np.allclose([tab[u][c] for c in range(4)], want)


def test_trial_table_readers(spark, tmp_path):
    email = tmp_path / "email.csv"
    email.write_text("recency,history_segment,history,mens,womens,zip_code,newbie,channel,segment,visit,conversion,spend\n"
                     "10,2) $100 - $200,142.44,1,0,Surburban,0,Phone,Womens E-Mail,0,0,0\n"
                     "6,3) $200 - $350,329.08,1,1,Rural,1,Web,No E-Mail,1,0,0\n")
    df = io.read_email_trial(spark, str(email))
    rows = sorted(df.collect(), key=lambda r: r.recency)
    assert [r.treatment for r in rows] == ["No E-Mail", "Womens E-Mail"] and rows[0].history == 329.08
    assert df.select("unit_id").distinct().count() == 2
    rec = discretize.recode_email_trial(df).orderBy("recency").collect()
    assert [(r.history_segment, r.zip_code, r.channel, r.treatment_binary) for r in rec] == [(2, 1, 1, 0), (1, 2, 0, 1)]
    pur = tmp_path / "p.csv"
    pur.write_text("client_id,transaction_id,transaction_datetime,regular_points_received,express_points_received,"
                   "regular_points_spent,express_points_spent,purchase_sum,store_id,product_id,product_quantity,"
                   "trn_sum_from_iss,trn_sum_from_red\nc1,t1,2019-01-01 10:00:00,1.5,0,0,0,100.0,s,p,2,90,\n")
    cli = tmp_path / "c.csv"
    cli.write_text("client_id,first_issue_date,first_redeem_date,age,gender\nc1,2017-01-01,,45,F\n")
    trn = tmp_path / "t.csv"
    trn.write_text("client_id,treatment_flg,target\nc1,1,0\n")
    p, c, t = io.read_retail_trial(spark, str(pur), str(cli), str(trn))
    r = p.collect()[0]
    assert (r.purchase_sum, r.product_quantity, r.trn_sum_from_red) == (100.0, 2.0, None)
    assert c.collect()[0].age == 45 and t.collect()[0].treatment_flg == 1


def test_retail_trial_features(spark, tmp_path):
    from causeway.operators.features import retail_trial_features
    hdr = ("client_id,transaction_id,transaction_datetime,regular_points_received,express_points_received,"
           "regular_points_spent,express_points_spent,purchase_sum,store_id,product_id,product_quantity,"
           "trn_sum_from_iss,trn_sum_from_red\n")
    rows = ["c1,t1,2019-01-01 10:00:00,1,0,0,0,100,s,p1,2,,", "c1,t1,2019-01-01 10:00:00,1,0,0,0,100,s,p2,3,,",
            "c1,t2,2019-01-02 10:00:00,3,0,0,0,300,s,p1,1,,", "c2,t3,2019-01-03 10:00:00,0,0,0,0,50,s,p1,4,,"]
    (tmp_path / "p.csv").write_text(hdr + "\n".join(rows) + "\n")
    (tmp_path / "c.csv").write_text("client_id,first_issue_date,first_redeem_date,age,gender\nc1,,,50,F\nc2,,,30,M\n")
    (tmp_path / "t.csv").write_text("client_id,treatment_flg,target\nc1,1,1\n")     # c2 is not in the trial
    p, c, t = io.read_retail_trial(spark, str(tmp_path / "p.csv"), str(tmp_path / "c.csv"), str(tmp_path / "t.csv"))
    got = retail_trial_features(p, c, t).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.client_id, r.num_transactions, r.avg_purchase, r.avg_product_quantity, r.age_binary) == ("c1", 2, 200.0, 3.0, 1)


def test_array_totals_one_rule(spark):
    """A NULL array counts nowhere and a ragged one is an error, with the size given or not."""
    from causeway.operators.estimators import ipw_full
    from causeway.operators.grid import array_totals
    rows = [(1, [0.1, 0.4, 0.2, 0.3]), (2, None), (3, [0.4, 0.1, 0.3, 0.2])]
    df = spark.createDataFrame(rows, "unit_id long, p array<double>")
    a = sorted(tuple(r) for r in array_totals(df, "p").select("pos", F.round("s", 9), "n").collect())
    b = sorted(tuple(r) for r in array_totals(df, "p", size=4).select("pos", F.round("s", 9), "n").collect())
    assert a == b and {x[2] for x in a} == {2}
    (x,), (y,) = (ipw_full(df, "p", size=s).select("n", F.round("ate", 9), F.round("uncorrected", 9)).collect() for s in (None, 4))
    assert x == y
    with pytest.raises(Exception, match="array of length 4 expected"):
        array_totals(spark.createDataFrame([(1, [0.5] * 8)], "unit_id long, p array<double>"), "p", size=4).collect()
