"""Entry tables (X1-X4, J9) from order entries built out of
orders/customer/lineitem/supplier, and reply chunks (S7) from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import entries as X
from feedloom.plans.registry import register
from feedloom.session import table
from feedloom.sources.chunks import assemble_chunks, parse_chunk_lines

_COMPANY_T = "array<struct<l_linenumber:int,name:string,business_model:string,customers:string>>"


def order_entries(spark, sf):
    """(episode_id, entry JSON): one entry per order; the customer is the
    guest, the suppliers of its lines (at most seven) are the companies,
    urgent orders carry an extra ``priority`` key."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    sup = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    comp = (li.join(sup, li.l_suppkey == sup.s_suppkey, "inner")
            .groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(
                F.col("l_linenumber"), F.col("s_name").alias("name"),
                F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("business_model"),
                F.floor("l_quantity").cast("bigint").cast("string").alias("customers")))).alias("companies")))
    o = (table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
         .join(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"),
               F.col("o_custkey") == F.col("c_custkey"), "inner"))
    e = o.join(comp, o.o_orderkey == comp.l_orderkey, "left")
    guest = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("background"),
                     F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("ideology"))
    companies = F.transform(F.coalesce(F.col("companies"), F.array().cast(_COMPANY_T)),
                            lambda x: F.struct(x["name"].alias("name"), x["business_model"].alias("business_model"),
                                               x["customers"].alias("customers")))
    entry = F.to_json(F.struct(F.array(guest).alias("guests"), companies.alias("companies"),
                               F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority")).alias("priority")))
    return e.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("episode_id"), entry.alias("entry"))


ORDERS_SQL = """
oc AS (SELECT o_orderkey, o_orderpriority, c_name, c_mktsegment, c_nationkey
       FROM orders JOIN customer ON o_custkey = c_custkey)"""


@register("entry_guests", f"""
WITH {ORDERS_SQL.strip()}
SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS episode_id, 0 AS pos, c_name AS name, c_mktsegment AS background,
       'nation ' || CAST(c_nationkey AS VARCHAR) AS ideology FROM oc""")
def entry_guests(spark, sf):
    return X.guests(X.entries(order_entries(spark, sf)))


@register("entry_companies", f"""
WITH {ORDERS_SQL.strip()}
SELECT 'o' || CAST(l_orderkey AS VARCHAR) AS episode_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, s_name,
         'nation ' || CAST(s_nationkey AS VARCHAR), CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR)) - 1 AS INTEGER) AS pos,
  s_name AS name, 'nation ' || CAST(s_nationkey AS VARCHAR) AS business_model,
  CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) AS customers
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
WHERE l_orderkey IN (SELECT o_orderkey FROM oc)""")
def entry_companies(spark, sf):
    return X.companies(X.entries(order_entries(spark, sf)))


@register("entry_keys", f"""
WITH {ORDERS_SQL.strip()}
SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS episode_id, k AS key
FROM oc, (VALUES ('guests'), ('companies')) t(k)
UNION ALL
SELECT 'o' || CAST(o_orderkey AS VARCHAR), 'priority' FROM oc WHERE o_orderpriority = '1-URGENT'""")
def entry_keys(spark, sf):
    return X.entry_keys(order_entries(spark, sf))


@register("chunk_text", """
WITH c AS (SELECT conv_id, turn, text, (role = 'assistant' AND turn % 4 = 3) AS done FROM conversations),
s AS (SELECT conv_id, min(turn) FILTER (WHERE done) AS stop FROM c GROUP BY conv_id)
SELECT c.conv_id AS request_id, string_agg(text, '' ORDER BY turn) AS text, bool_or(stop IS NOT NULL) AS complete
FROM c JOIN s USING (conv_id) WHERE stop IS NULL OR turn <= stop GROUP BY c.conv_id""")
def chunk_text(spark, sf):
    conv = table(spark, sf, "conversations")
    done = (F.col("role") == "assistant") & (F.col("turn") % 4 == 3)
    lines = conv.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"),
                        F.to_json(F.struct(F.struct(F.col("role").alias("role"), F.col("text").alias("content")).alias("message"),
                                           done.alias("done"))).alias("line"))
    return assemble_chunks(parse_chunk_lines(lines)).select("request_id", "text", "complete")
