"""Retail client features.

Line items are pre-aggregated per transaction *before* any join (map-side partial
aggregation shrinks the largest table first).  Lines that carry the client are grouped by
(client, transaction), so a transaction id that two clients share counts for each apart;
other lines get the client from a transaction table, where an id has one client.  The
distinct-transaction count (E1) is the row count of that level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_non_null(value: str, order):
    """pandas ``last`` in a group: the value of the last row (by ``order``) where it is
    not NULL.  Input order must be made explicit: a row position is not stable in a
    distributed scan.  Keep ``order`` a primitive column (e.g. an encoded BIGINT):
    a struct ordering key forces a sort-based aggregate over the whole input."""
    key = F.col(order) if isinstance(order, str) else order
    return F.max_by(F.col(value), F.when(F.col(value).isNotNull(), key))


def _mean(c):
    # sum / count written out, so integer inputs give the exactly rounded quotient
    return F.sum(c).cast("double") / F.count(c)


def client_features(lines: DataFrame, transactions: DataFrame | None, clients: DataFrame, order_col,
                    txn: str = "transaction_id", client: str = "client_id") -> DataFrame:
    """lines: txn, order column(s), purchase_sum, regular_points_received, product_quantity
    transactions: txn, client (None where the lines hold the client); clients: client + client attributes (inner join, D5).
    ``order_col`` is one ordering column or a dict value -> ordering column."""
    def order_of(v):
        return order_col[v] if isinstance(order_col, dict) else order_col
    level1 = (lines.groupBy(*([client] if transactions is None else []), txn)
              .agg(last_non_null("purchase_sum", order_of("purchase_sum")).alias("purchase_sum"),       # E3
                   last_non_null("regular_points_received", order_of("regular_points_received"))
                   .alias("regular_points_received"),
                   F.sum("product_quantity").alias("product_quantity")))
    per_client = ((level1 if transactions is None else level1.join(transactions, txn))
                  .groupBy(client)
                  .agg(_mean("purchase_sum").alias("avg_purchase"),                                # E4
                       _mean("regular_points_received").alias("avg_regular_points_received"),
                       _mean("product_quantity").alias("avg_product_quantity"),
                       F.count("*").cast("bigint").alias("num_transactions")))                     # E1
    return per_client.join(clients, client)                                                        # D5


def retail_trial_features(purchases: DataFrame, clients: DataFrame, train: DataFrame,
                          age_threshold: int = 45) -> DataFrame:
    """The retail trial's client table: per-transaction last purchase sum / points and
    summed quantity (ordered by transaction time, a primitive key), per-client means and
    distinct-transaction count, joined to client ages and restricted to the trial's clients
    (D5); ``age_binary`` = age > threshold.  Rows of one transaction share its time, and the
    per-transaction values repeat on them, so ties in the order key are harmless."""
    order = F.unix_timestamp("transaction_datetime")
    lines = purchases.select("client_id", "transaction_id", order.alias("_ts"), "purchase_sum", "regular_points_received",
                             "product_quantity")
    attrs = clients.select("client_id", "age").join(train.select("client_id", "treatment_flg", "target"), "client_id")
    out = client_features(lines, None, attrs, order_col="_ts")
    return out.withColumn("age_binary", F.when(F.col("age") <= age_threshold, 0)
                          .when(F.col("age") > age_threshold, 1).cast("int"))
