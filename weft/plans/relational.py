"""Queries over the star schema: joins, rollups, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.plans.registry import query
from weft.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    """Registers a query that is written in SQL that both engines read."""

    def run(spark, sf_dir):
        for t in TABLES:
            if t in text:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(text)

    query(name, oracle or text)(run)


_sql(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
)
_sql(
    "revenue_by_nation",
    """SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY n_name, r_name""",
)
_sql("segment_rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
_sql("status_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_sql("order_rank_by_customer", "SELECT o_custkey, o_orderkey, CAST(r AS INT) AS r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) x WHERE r <= 2")
_sql("customers_without_orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_sql("large_orders_semi", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200)")
_sql("nations_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
_sql("nations_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9900 INTERSECT SELECT s_nationkey AS k FROM supplier")
_sql("parts_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45")


@query("corpus_rollup", "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def corpus_rollup(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
