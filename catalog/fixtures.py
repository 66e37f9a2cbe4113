"""Views the queries run on: plain SQL that both engines accept, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from winnow.session import spread

# labelled mixed table with missing values, one row per order
DS = """
SELECT o.o_orderkey AS row_id,
       CASE WHEN o.o_orderkey % 7  = 0 THEN NULL ELSE o.o_totalprice END AS f_price,
       CASE WHEN o.o_orderkey % 11 = 3 THEN NULL ELSE c.c_acctbal    END AS f_acctbal,
       CAST(month(o.o_orderdate) AS DOUBLE)  AS f_month,
       CAST(o.o_custkey % 10 AS DOUBLE)      AS f_tier,
       CAST(1 AS DOUBLE)                     AS f_const,
       CASE WHEN o.o_orderkey % 13 = 5 THEN NULL ELSE c.c_mktsegment END AS c_segment,
       o.o_orderstatus   AS c_status,
       o.o_orderpriority AS label
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
"""

# skewed numeric table
EV = """
SELECT event_id AS row_id,
       CASE WHEN event_id % 9 = 4 THEN NULL ELSE value END AS f_value,
       CAST(hour(ts) AS DOUBLE)      AS f_hour,
       CAST(user_id % 17 AS DOUBLE)  AS f_bucket,
       event_type AS label
FROM events
"""

# evaluated step sequences, one row per part
TRIALS = """
SELECT p_brand AS dataset, p_partkey AS trial_id,
       CASE p_partkey % 4 WHEN 0 THEN 'O_E_N_FT' WHEN 1 THEN 'E_O_N_FT'
                          WHEN 2 THEN 'E_O_FT_N' ELSE 'E_N' END AS logic_pipe,
       CASE p_partkey % 4
         WHEN 0 THEN concat_ws('_', o, e, n, ft) WHEN 1 THEN concat_ws('_', e, o, n, ft)
         WHEN 2 THEN concat_ws('_', e, o, ft, n) ELSE concat_ws('_', e, n) END AS phy_pipe,
       CAST((p_partkey * 37) % 1000 AS DOUBLE) / 1000 AS accuracy
FROM (SELECT p_brand, p_partkey,
        CASE p_partkey % 2 WHEN 0 THEN 'zscore' ELSE 'iqr' END AS o,
        CASE p_partkey % 3 WHEN 0 THEN 'onehot' WHEN 1 THEN 'label' ELSE 'binary' END AS e,
        CASE p_partkey % 5 WHEN 0 THEN 'standard' WHEN 1 THEN 'minmax' WHEN 2 THEN 'robust'
                           WHEN 3 THEN 'power' ELSE 'quantile' END AS n,
        CASE p_partkey % 7 WHEN 0 THEN 'pca' WHEN 1 THEN 'polynomial' ELSE 'none' END AS ft
      FROM part) x
"""

# predictions with no model in between
PRED = """
SELECT o_orderkey AS row_id, o_orderpriority AS label,
       CASE WHEN o_orderkey % 3 = 0 THEN '1-URGENT' WHEN o_orderkey % 5 = 0 THEN '5-LOW'
            ELSE o_orderpriority END AS prediction
FROM orders
"""

# many small tables: ds by nation
KB = """
SELECT CAST(c.c_nationkey AS STRING) AS dataset, d.*
FROM ds d JOIN orders o ON o.o_orderkey = d.row_id JOIN customer c ON c.c_custkey = o.o_custkey
"""

# scaling method tried per column
COLSTRAT = """
SELECT p_partkey AS trial_id,
       CASE p_partkey % 4 WHEN 0 THEN 'standard' WHEN 1 THEN 'minmax' WHEN 2 THEN 'kbins' END AS f_price,
       CASE p_partkey % 6 WHEN 0 THEN 'power' WHEN 1 THEN 'robust' WHEN 2 THEN 'unlisted' ELSE 'none' END AS f_acctbal,
       CAST((p_partkey * 37) % 1000 AS DOUBLE) / 1000 AS accuracy
FROM part
"""

# search log
LEDGER = """
SELECT trial_id % 3 AS run_id, CAST(floor(trial_id / 3.0) AS BIGINT) + 1 AS iteration,
       logic_pipe AS step_order, split(phy_pipe, '_') AS ops, accuracy AS score
FROM trials
"""

# best five recorded sequences of each data set; the imputer comes first, 'none' is a skip
RECORDED = """
SELECT dataset, trial_id, accuracy AS score, logic_pipe, phy_pipe,
       CASE trial_id % 3 WHEN 0 THEN 'mean' WHEN 1 THEN 'median' ELSE 'knn' END AS imputer,
       CAST(place - 1 AS INT) AS pos
FROM (SELECT t.*, row_number() OVER (PARTITION BY dataset ORDER BY accuracy DESC, trial_id) AS place
      FROM trials t) y
WHERE place <= 5
"""

NEEDS = {
    "ds": ("orders", "customer"),
    "ev": ("events",),
    "trials": ("part",),
    "pred": ("orders",),
    "kb": ("ds", "orders", "customer"),
    "colstrat": ("part",),
    "ledger": ("trials",),
    "recorded": ("trials",),
}
BODY = {
    "ds": DS, "ev": EV, "trials": TRIALS, "pred": PRED, "kb": KB, "colstrat": COLSTRAT,
    "ledger": LEDGER, "recorded": RECORDED,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for n in NEEDS[name]:
        src = view(spark, sf_dir, n) if n in BODY else table(spark, sf_dir, n)
        src.createOrReplaceTempView(n)
    return spark.sql(BODY[name])


def with_views(names: list[str], body: str, extra: str = "") -> str:
    """SQL text: the views named (and what they need) as a WITH block, then ``body``."""
    order: list[str] = []

    def visit(n):
        for m in NEEDS.get(n, ()):
            if m in BODY:
                visit(m)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    blocks = [f"{n} AS ({BODY[n]})" for n in order]
    if extra.strip():
        blocks.append(extra.strip().strip(","))
    return "WITH " + ",\n".join(blocks) + "\n" + body
