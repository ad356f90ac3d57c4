"""Grids and site tables derived from the business tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 256
SIZES = (2, 4, 8, 16, 32, 64)
QS = (-2.0, 0.0, 1.0, 2.0)
RADII = [0, 1, 2, 3, 4]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 256 x 256 site: cells with the largest quantity as their height."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 40")
    return li.groupBy((F.col("l_orderkey") % SIDE).alias("y"), (F.col("l_partkey") % SIDE).alias("x")).agg(F.max("l_quantity").alias("h")).select(F.lit(0).cast("long").alias("site"), "y", "x", "h")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 64 x 64 site for each supplier nation."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 40")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("site"))
    return li.join(s, "l_suppkey").groupBy("site", (F.col("l_orderkey") % 64).alias("y"), (F.col("l_partkey") % 64).alias("x")).agg(F.max("l_quantity").alias("h"))


def square(spark: SparkSession, side: int = SIDE) -> DataFrame:
    ids = spark.range(side * side)
    return ids.select(F.lit(0).cast("long").alias("site"), F.expr(f"id div {side}").alias("y"), (F.col("id") % side).alias("x"))


def disk(spark: SparkSession) -> DataFrame:
    return square(spark).where("(y - 128) * (y - 128) + (x - 128) * (x - 128) <= 120 * 120")


def customer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table (site = nation, feature, value, subset = region) of per-nation figures."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("subset"))
    by = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.count(F.lit(1)).cast("double").alias("orders"), F.round(F.avg("o_totalprice"), 6).alias("price"))
    own = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).cast("double").alias("customers"), F.round(F.avg("c_acctbal"), 6).alias("balance"), F.max("c_acctbal").alias("top_balance"))
    wide = own.join(by, "c_nationkey", "left").join(n, "c_nationkey")
    return wide.select(F.col("c_nationkey").cast("long").alias("site"), "subset", F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).alias("value")) for k in ("orders", "price", "customers", "balance", "top_balance")])).alias("f")).select("site", "subset", "f.feature", "f.value")


#: SQL of the same tables.
HEIGHTS = "heights AS (SELECT 0::BIGINT AS site, CAST(l_orderkey % 256 AS BIGINT) AS y, CAST(l_partkey % 256 AS BIGINT) AS x, MAX(l_quantity) AS h FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40 GROUP BY 2, 3)"
SITES = "sites AS (SELECT s_nationkey::BIGINT AS site, CAST(l_orderkey % 64 AS BIGINT) AS y, CAST(l_partkey % 64 AS BIGINT) AS x, MAX(l_quantity) AS h FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R' AND l_quantity > 40 GROUP BY 1, 2, 3)"
SQUARE = "square AS (SELECT 0::BIGINT AS site, a.y::BIGINT AS y, b.x::BIGINT AS x FROM range(256) a(y), range(256) b(x))"
DISK = SQUARE + ", disk AS (SELECT * FROM square WHERE (y - 128) * (y - 128) + (x - 128) * (x - 128) <= 120 * 120)"
FEATURES = """own AS (SELECT c_nationkey AS k, count(*)::DOUBLE AS customers, round(avg(c_acctbal), 6) AS balance, max(c_acctbal) AS top_balance FROM customer GROUP BY 1),
 bought AS (SELECT c_nationkey AS k, count(*)::DOUBLE AS orders, round(avg(o_totalprice), 6) AS price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
 wide AS (SELECT own.k::BIGINT AS site, r_name AS subset, customers, balance, top_balance, orders, price FROM own LEFT JOIN bought USING (k) JOIN nation ON n_nationkey = own.k JOIN region ON r_regionkey = n_regionkey),
 features AS (SELECT site, subset, 'orders' AS feature, orders AS value FROM wide UNION ALL SELECT site, subset, 'price', price FROM wide UNION ALL SELECT site, subset, 'customers', customers FROM wide
   UNION ALL SELECT site, subset, 'balance', balance FROM wide UNION ALL SELECT site, subset, 'top_balance', top_balance FROM wide)"""
