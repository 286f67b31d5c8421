"""Queries in the event-table dialect over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogue import query, table
from .ek import ek_sql


def _run(spark, sf_dir, text, names):
    return ek_sql(spark, text, {n: table(spark, sf_dir, n) for n in names})


def _add(name, text, names, sql):
    query(name, sql)(lambda spark, sf_dir: _run(spark, sf_dir, text, names))


_add("ek_equi_join", 'SELECT N.N_NAME, R.R_NAME FROM NATION N, REGION R WHERE N.N_REGIONKEY = R.R_REGIONKEY AND R.R_NAME LIKE "*A*" ORDER BY N.N_NAME DESC', ["nation", "region"],
     "SELECT n_name AS N_NAME, r_name AS R_NAME FROM nation, region WHERE n_regionkey = r_regionkey AND r_name ILIKE '%A%' ORDER BY n_name DESC")
_add("ek_select_where_like", "SELECT P_NAME, P_BRAND, P_SIZE FROM PART WHERE P_NAME LIKE '*a%' AND P_SIZE GE 10", ["part"],
     "SELECT p_name AS P_NAME, p_brand AS P_BRAND, p_size AS P_SIZE FROM part WHERE p_name ILIKE '%a_' AND p_size >= 10")
_add("ek_not_like", "SELECT C_CUSTKEY, C_MKTSEGMENT FROM CUSTOMER WHERE C_MKTSEGMENT NOT LIKE 'b*'", ["customer"],
     "SELECT c_custkey AS C_CUSTKEY, c_mktsegment AS C_MKTSEGMENT FROM customer WHERE c_mktsegment NOT ILIKE 'b%'")
_add("ek_between", "SELECT S_SUPPKEY, S_ACCTBAL FROM SUPPLIER WHERE S_ACCTBAL BETWEEN 0 AND 5000 AND S_NATIONKEY NOT BETWEEN 3 AND 9", ["supplier"],
     "SELECT s_suppkey AS S_SUPPKEY, s_acctbal AS S_ACCTBAL FROM supplier WHERE s_acctbal BETWEEN 0 AND 5000 AND s_nationkey NOT BETWEEN 3 AND 9")
_add("ek_or_dedup", "SELECT EVENT_ID, EVENT_TYPE FROM EVENTS WHERE VALUE > 50 OR USER_ID < 20 OR EVENT_TYPE EQ 'click'", ["events"],
     "SELECT event_id AS EVENT_ID, event_type AS EVENT_TYPE FROM events WHERE value > 50 OR user_id < 20 OR event_type = 'click'")
_add("ek_parens_not", "SELECT EVENT_ID FROM EVENTS WHERE NOT (VALUE > 50 OR USER_ID < 20) AND EVENT_TYPE NE 'view'", ["events"],
     "SELECT event_id AS EVENT_ID FROM events WHERE NOT (value > 50 OR user_id < 20) AND event_type <> 'view'")
_add("ek_time_literal", "SELECT EVENT_ID, TS FROM EVENTS WHERE TS GE '2024-01-01T06:00:00' ORDER BY TS, EVENT_ID", ["events"],
     "SELECT event_id AS EVENT_ID, ts AS TS FROM events WHERE ts >= TIMESTAMP '2024-01-01 06:00:00'")
_add("ek_order_multi", "SELECT O_ORDERKEY, O_ORDERSTATUS, O_TOTALPRICE FROM ORDERS WHERE O_TOTALPRICE > 200000 ORDER BY O_ORDERSTATUS, O_TOTALPRICE DESC", ["orders"],
     "SELECT o_orderkey AS O_ORDERKEY, o_orderstatus AS O_ORDERSTATUS, o_totalprice AS O_TOTALPRICE FROM orders WHERE o_totalprice > 200000")
_add("ek_non_equi_join", "SELECT A.S_SUPPKEY, B.S_SUPPKEY FROM SUPPLIER A, SUPPLIER B WHERE A.S_NATIONKEY = B.S_NATIONKEY AND A.S_ACCTBAL < B.S_ACCTBAL", ["supplier"],
     "SELECT a.s_suppkey AS A_S_SUPPKEY, b.s_suppkey AS B_S_SUPPKEY FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
_add("ek_cross_join", "SELECT R.R_NAME, N.N_NAME FROM REGION R, NATION N", ["region", "nation"],
     "SELECT r_name AS R_NAME, n_name AS N_NAME FROM region, nation")
_add("ek_three_tables", "SELECT C_NAME, N_NAME, R_NAME FROM CUSTOMER, NATION, REGION WHERE C_NATIONKEY = N_NATIONKEY AND N_REGIONKEY = R_REGIONKEY AND C_ACCTBAL > 9000", ["customer", "nation", "region"],
     "SELECT c_name AS C_NAME, n_name AS N_NAME, r_name AS R_NAME FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9000")


@query("ek_is_null", "SELECT event_id AS EVENT_ID FROM (SELECT event_id, nullif(event_type, 'click') AS kind FROM events) WHERE kind IS NULL")
def ek_is_null(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("kind", F.expr("nullif(event_type, 'click')"))
    return ek_sql(spark, "SELECT EVENT_ID FROM E WHERE KIND = NULL", {"e": events})


@query("ek_not_null_order", "SELECT event_id AS EVENT_ID, kind AS KIND FROM (SELECT event_id, nullif(event_type, 'click') AS kind FROM events WHERE value > 90) WHERE kind IS NOT NULL")
def ek_not_null_order(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("value > 90").withColumn("kind", F.expr("nullif(event_type, 'click')"))
    return ek_sql(spark, "SELECT EVENT_ID, KIND FROM E WHERE KIND IS NOT NULL ORDER BY KIND DESC, EVENT_ID", {"e": events})
