"""The driver's tables in the roles that the queries give them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDERS = ["URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts over at least as many partitions as there are cores: only one of fewer, which is small, is dealt anew."""
    df, cores = read(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sighting of an entity (a customer in one year) by a provider (an order priority) for each order.

    The year is part of the name, as over all years nearly every customer has every provider.
    """
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    provider = F.regexp_replace("o_orderpriority", "^[0-9]-", "")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        F.col("o_orderkey").alias("ordinal"), F.concat(F.year("o_orderdate").cast("string"), F.lit(" "), F.col("c_name")).alias("name"), provider.alias("provider"),
        F.col("n_name").alias("country"), F.col("c_mktsegment").alias("broad"), F.col("o_orderstatus").alias("sub"),
        F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("https://shop.example/"), (F.col("o_orderkey") % 10).cast("string"))).otherwise("").alias("url"), F.concat(provider, F.lit(".csv")).alias("file"),
    )


#: SQL for listings and for their first row of each key and provider.
LISTING = """listing AS (
  SELECT o_orderkey AS ordinal, year(o_orderdate) || ' ' || c_name AS name, regexp_replace(o_orderpriority, '^[0-9]-', '') AS provider, n_name AS country, c_mktsegment AS broad, o_orderstatus AS sub,
         CASE WHEN o_orderkey % 3 <> 0 THEN 'https://shop.example/' || (o_orderkey % 10) ELSE '' END AS url, regexp_replace(o_orderpriority, '^[0-9]-', '') || '.csv' AS file
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""
MASTER = LISTING + """, master AS (
  SELECT ordinal, regexp_replace(name, '\\s+', '', 'g') AS name, provider, country, broad, sub, url, file, entity_key FROM (
    SELECT *, row_number() OVER (PARTITION BY entity_key, provider ORDER BY ordinal) AS rn FROM (
      SELECT *, regexp_replace(replace(lower(regexp_replace(name, '\\s+', '', 'g')), '&', 'and'), '[^a-z0-9]+', '', 'g') AS entity_key FROM listing))
  WHERE rn = 1 AND entity_key <> ''
)"""


def mode_sql(column: str, source: str = "master", key: str = "entity_key") -> str:
    """The commonest value of a column for each key, ties to the smallest."""
    return f"""(SELECT {key}, {column} AS m FROM (SELECT {key}, {column}, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {column}) AS rn FROM {source} WHERE trim({column}) <> '' GROUP BY {key}, {column}) WHERE rn = 1)"""
