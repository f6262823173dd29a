"""Queries over a folder of Parquet tables, each with the DuckDB SQL that it should equal."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.functions.expressions import any_term, apply_filter, missing
from plumbline.operators import aggregates as A
from plumbline.operators import analytics as N
from plumbline.operators import joins as J
from plumbline.operators import nested as D
from plumbline.operators import records as C
from plumbline.operators import tracks as K
from plumbline.operators import transforms as T
from plumbline.plans import flow as P
from plumbline.sources import files as R
from plumbline.streaming import sampling as M

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def money(c: str | Column) -> Column:
    """Exact sums of doubles that hold cents."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def col(name: str) -> dict:
    return {"column_name": [name]}


def lit(value) -> dict:
    return {"literal": [value]}


# filters -----------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part WHERE (p_size >= 10 AND p_size < 30 AND p_type IS NOT NULL) OR (lower(p_brand) = 'brand#13' AND NOT p_size = 7)")
def filter_tree(spark, d):
    tree = {
        "or": [
            {"and": [{"greater_or_equal": [col("p_size"), lit(10)]}, {"lesser": [col("p_size"), lit(30)]}, {"not_null": [col("p_type")]}]},
            {"and": [{"equal": [{"to_lowercase": [col("p_brand")]}, lit("brand#13")]}, {"not": [{"equal": [col("p_size"), lit(7)]}]}]},
        ]
    }
    return apply_filter(t(spark, d, "part"), tree).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_mktsegment), 'buil') AND starts_with(lower(c_name), 'customer')")
def filter_contains_starts_any_case(spark, d):
    tree = {"and": [{"contains_case_insensitive": [col("c_mktsegment"), lit("BUIL")]}, {"starts_with_case_insensitive": [col("c_name"), lit("CUSTOMER")]}]}
    return apply_filter(t(spark, d, "customer"), tree).select("c_custkey", "c_name")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 20")
def filter_json_field(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return t(spark, d, "events").select("event_id", k.alias("k")).where("k between 10 and 20")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-05'")
def filter_time_window(spark, d):
    rows = N.window_filter(t(spark, d, "events"), "ts", datetime(2024, 1, 2), datetime(2024, 1, 5), event_type="click")
    return rows.select("event_id", "event_type")


@query("SELECT doc_id, source FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def duplicates_only(spark, d):
    return T.apply_transforms(t(spark, d, "documents"), [{"type": "duplicate_only", "spec": ["text"]}, {"type": "select", "spec": ["doc_id", "source"]}])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) IN (1995, 1996) AND month(o_orderdate) = 3")
def filter_year_month(spark, d):
    return N.in_months(t(spark, d, "orders"), "o_orderdate", [1995, 1996], [3]).select("o_orderkey", "o_totalprice")


# aggregation -------------------------------------------------------------


@query("SELECT event_type, count(value) AS \"count\", min(value) AS min, max(value) AS max, round(avg(value), 6) AS avg, round(sum(value), 4) AS sum FROM events GROUP BY event_type")
def stats_one_pass(spark, d):
    out = N.stats(t(spark, d, "events"), "value", ["event_type"])
    return out.select("event_type", "count", "min", "max", F.round("avg", 6).alias("avg"), F.round("sum", 4).alias("sum"))


@query("SELECT count(*) AS n FROM events WHERE event_type <> 'click'")
def count_filtered(spark, d):
    return N.count_rows(t(spark, d, "events").where("event_type <> 'click'"))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1000")
def terms_by_count(spark, d):
    return N.terms(t(spark, d, "lineitem"), "l_suppkey")


@query("SELECT l_partkey, count(*) AS n, round(avg(CAST(l_extendedprice AS DECIMAL(18,2))), 4) AS metric FROM lineitem GROUP BY 1 ORDER BY sum(CAST(l_extendedprice AS DECIMAL(18,2)))/count(*) DESC, 1 LIMIT 20")
def terms_by_avg(spark, d):
    return N.terms(t(spark, d, "lineitem"), "l_partkey", F.avg(money("l_extendedprice")), size=20).withColumn("metric", F.round(F.col("metric").cast("double"), 4))


@query(
    "SELECT r.lo AS \"from\", r.hi AS \"to\", count(o_orderkey) AS n FROM (VALUES (0.0::DOUBLE, 1000.0::DOUBLE), (500.0, 50000.0), (40000.0, 1000000.0), (2000000.0, 3000000.0)) r(lo, hi)"
    " LEFT JOIN orders ON o_totalprice >= r.lo AND o_totalprice < r.hi GROUP BY 1, 2"
)
def range_buckets_overlapping(spark, d):
    return N.range_buckets(t(spark, d, "orders"), "o_totalprice", [(0, 1000), (500, 50000), (40000, 1000000), (2000000, 3000000)])


HISTOGRAM = """
WITH b AS (SELECT CAST(floor(epoch_ms(ts) / 3600000.0) AS BIGINT) * 3600000 AS bucket, count(*) AS n, max(value) AS most FROM events GROUP BY 1),
s AS (SELECT unnest(generate_series((SELECT min(bucket) FROM b) - 7200000, (SELECT max(bucket) FROM b), 3600000)) AS bucket)
SELECT s.bucket, coalesce(n, 0) AS n, most FROM s LEFT JOIN b USING (bucket)
"""


@query(HISTOGRAM)
def date_histogram_zero_fill(spark, d):
    return N.date_histogram(t(spark, d, "events"), "ts", 3_600_000, [F.max("value").alias("most")], before=7_200_000)


@query(
    "WITH b AS (SELECT CAST(floor(epoch_ms(ts) / 86400000.0) AS BIGINT) * 86400000 AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2),"
    " s AS (SELECT unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b), 86400000)) AS bucket)"
    " SELECT s.bucket, e.event_type, coalesce(n, 0) AS n FROM s CROSS JOIN (SELECT DISTINCT event_type FROM b) e LEFT JOIN b ON b.bucket = s.bucket AND b.event_type = e.event_type"
)
def histogram_with_terms(spark, d):
    return N.date_histogram(t(spark, d, "events"), "ts", 86_400_000, groups=["event_type"])


@query(
    "WITH e AS (SELECT *, (SELECT max(epoch_ms(ts)) FROM events) - epoch_ms(ts) AS age FROM events)"
    " SELECT event_type, r.k AS range, count(*) AS n, max(value) AS most FROM e JOIN (VALUES ('1m', 60000), ('1h', 3600000), ('1d', 86400000), ('1w', 604800000), ('1M', 2629746000)) r(k, w) ON age <= r.w GROUP BY 1, 2"
)
def trailing_ranges_rollup(spark, d):
    return N.trailing_ranges(t(spark, d, "events"), "ts", None, ["event_type"], [F.count("*").alias("n"), F.max("value").alias("most")])


@query(
    "SELECT l_returnflag, count(l_orderkey) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS total, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS middle,"
    " min(l_shipdate) AS first, max(l_shipdate) AS last, round(100.0 * sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) / count(*), 6) AS discounted FROM lineitem GROUP BY 1"
)
def summarize_all(spark, d):
    rows = t(spark, d, "lineitem").withColumn("l_extendedprice", money("l_extendedprice")).withColumn("big", F.col("l_discount") > 0.05)
    made = [("count", "l_orderkey", "n"), ("sum", "l_extendedprice", "total"), ("mean", "l_quantity", "mean"), ("median", "l_quantity", "middle"), ("min", "l_shipdate", "first"), ("max", "l_shipdate", "last"), ("percentage_true", "big", "discounted")]
    out = A.summarize(rows, ["l_returnflag"], [dict(zip(("function", "column", "alias"), m, strict=True)) for m in made])
    return out.withColumns({"total": F.col("total").cast("double"), "mean": F.round("mean", 6), "discounted": F.round("discounted", 6)})


@query(
    "WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)"
    " SELECT c_nationkey, (SELECT c_mktsegment FROM c x WHERE x.c_nationkey = c.c_nationkey ORDER BY n DESC, c_mktsegment LIMIT 1) AS common,"
    " list_sort(list(DISTINCT c_mktsegment)) AS segments FROM c GROUP BY c_nationkey"
)
def summarize_mode_and_list(spark, d):
    made = [{"function": "mode", "column": "c_mktsegment", "alias": "common"}, {"function": "distinct_aggregate_to_array", "column": "c_mktsegment", "alias": "segments"}]
    return T.apply_transforms(t(spark, d, "customer"), [{"type": "summarize", "spec": {"groups": ["c_nationkey"], "aggregations": made}}])


@query("WITH o AS (SELECT o_orderstatus, o_orderdate, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderstatus, min(o_orderdate) AS middle FROM o WHERE 2 * r >= n GROUP BY 1")
def median_of_times(spark, d):
    return A.ordinal_median(t(spark, d, "orders"), ["o_orderstatus"], "o_orderdate", "middle")


@query(
    "WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders WHERE month(o_orderdate) NOT IN (2, 7) GROUP BY 1),"
    " s AS (SELECT unnest(generate_series((SELECT min(m) FROM m), (SELECT max(m) FROM m), INTERVAL 1 MONTH)) AS m)"
    " SELECT strftime(s.m, '%Y') || '-' || CAST(month(s.m) AS VARCHAR) AS month, coalesce(n, 0) AS n FROM s LEFT JOIN m ON s.m = m.m"
)
def month_counts_zero_fill(spark, d):
    return N.month_counts(t(spark, d, "orders").where("month(o_orderdate) NOT IN (2, 7)"), "o_orderdate")


@query("SELECT c_mktsegment, count(*) AS n, CAST(floor(100.0 * count(*) / (SELECT count(*) FROM customer WHERE c_mktsegment <> '') + 0.5) AS BIGINT) AS percent FROM customer WHERE c_mktsegment <> '' GROUP BY 1")
def share_percent_rounded(spark, d):
    return A.share_percent(t(spark, d, "customer"), "c_mktsegment")


@query("SELECT r_name, n_name, count(*) AS n, CAST(2 - (GROUPING(r_name) + GROUPING(n_name)) AS INTEGER) AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def sunburst_rollup(spark, d):
    rows = J.fk_path_join(t(spark, d, "customer"), [(t(spark, d, "nation"), "n_nationkey", "c_nationkey"), (t(spark, d, "region"), "r_regionkey", "n_regionkey")])
    return N.rollup_counts(rows, ["r_name", "n_name"])


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority), ())")
def grouping_sets_jobs(spark, d):
    keys = ["o_orderstatus", "o_orderpriority"]
    return t(spark, d, "orders").groupingSets([keys, keys[:1], keys[1:], []], *keys).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count_if(o_orderstatus = 'F') AS n_f, count_if(o_orderstatus = 'O') AS n_o, count_if(o_orderstatus = 'P') AS n_p FROM orders GROUP BY 1")
def conditional_counts(spark, d):
    return D.counts_by_value(t(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"])


@query(
    "SELECT o_custkey, CASE WHEN count_if(o_orderstatus = 'F') > 0 THEN 'success' WHEN count_if(o_orderstatus = 'P') > 0 THEN 'in progress' ELSE 'failed' END AS outcome FROM orders GROUP BY 1"
)
def tri_state_rollup(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(A.outcome(F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") == "P")).alias("outcome"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) = 1")
def distinct_on_first(spark, d):
    return A.first_per_key(t(spark, d, "conversations"), ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")]).select("conv_id", "turn", "role")


@query("WITH w AS (SELECT unnest(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+')) AS word FROM documents) SELECT word, count(*) AS n, round(ln(count(*)), 9) AS ln FROM w WHERE word <> '' GROUP BY 1 ORDER BY n DESC, word LIMIT 50")
def wordcount_ln(spark, d):
    return N.word_counts(t(spark, d, "documents"), "text", 50).withColumn("ln", F.round("ln", 9))


@query("SELECT label, list(m ORDER BY i) AS mean FROM (SELECT label, i, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1")
def mean_vector(spark, d):
    out = t(spark, d, "embeddings").groupBy("label").agg(A.mean_vector(F.col("embedding"), 64).alias("mean"))
    return out.withColumn("mean", F.transform("mean", lambda x: F.round(x, 6)))


@query("SELECT l_suppkey, count(*) AS n, round(avg(l_discount), 6) AS mean, max(l_shipdate) AS last FROM lineitem WHERE l_quantity > 10 GROUP BY 1 ORDER BY avg(l_discount) DESC, 2 DESC, 4 DESC, 1")
def rating_summary(spark, d):
    return N.rated(t(spark, d, "lineitem").where("l_quantity > 10"), "l_suppkey", "l_discount", "l_shipdate").withColumn("mean", F.round("mean", 6))


@query(
    "SELECT s_suppkey, s_name, count(DISTINCT l_orderkey) AS orders, sum(CAST(l_extendedprice AS DECIMAL(18,2)))::DOUBLE AS metric FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2 ORDER BY 4 DESC, 1 LIMIT 10"
)
def top_suppliers(spark, d):
    best = N.terms(t(spark, d, "lineitem"), "l_suppkey", F.sum(money("l_extendedprice")), size=10).drop("n")
    orders = t(spark, d, "lineitem").join(F.broadcast(best), "l_suppkey").groupBy("l_suppkey", "metric").agg(F.count_distinct("l_orderkey").alias("orders"))
    rows = J.fk_path_join(orders, [(t(spark, d, "supplier"), "s_suppkey", "l_suppkey")])
    return rows.select("s_suppkey", "s_name", "orders", F.col("metric").cast("double").alias("metric"))


@query(
    "WITH f AS (SELECT date_diff('second', o_orderdate, l_shipdate) > 60 * 86400 + 86399 AS late, l_quantity > 40 AS large, l_discount > 0.08 AS cut FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
    " SELECT * FROM (SELECT 'late' AS flag, 'late' AS other, count_if(late) AS n FROM f UNION ALL SELECT 'late', 'large', count_if(late AND large) FROM f UNION ALL SELECT 'late', 'cut', count_if(late AND cut) FROM f"
    " UNION ALL SELECT 'large', 'late', count_if(large AND late) FROM f UNION ALL SELECT 'large', 'large', count_if(large) FROM f UNION ALL SELECT 'large', 'cut', count_if(large AND cut) FROM f"
    " UNION ALL SELECT 'cut', 'late', count_if(cut AND late) FROM f UNION ALL SELECT 'cut', 'large', count_if(cut AND large) FROM f UNION ALL SELECT 'cut', 'cut', count_if(cut) FROM f)"
)
def day_difference_flag_matrix(spark, d):
    rows = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    late = S.whole_days(F.col("o_orderdate"), F.col("l_shipdate")) > 60
    return D.flag_matrix(rows.select(late.alias("late"), (F.col("l_quantity") > 40).alias("large"), (F.col("l_discount") > 0.08).alias("cut")), ["late", "large", "cut"])


# windows, order, pages -----------------------------------------------------


@query(
    "SELECT c_custkey, count(*) OVER w AS n, first_value(c_mktsegment) OVER w AS first_segment, first_value(c_nationkey) OVER w AS first_nation, last_value(c_mktsegment) OVER w AS last_segment,"
    " last_value(c_nationkey) OVER w AS last_nation, dense_rank() OVER (ORDER BY c_mktsegment, c_nationkey) AS group_id FROM customer"
    " WINDOW w AS (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_mktsegment, c_nationkey RANGE BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
)
def group_metadata(spark, d):
    out = T.group_metadata(t(spark, d, "customer"), ["c_mktsegment", "c_nationkey"])
    ends = [F.col(f"group_metadata.{e}_value.{c}").alias(f"{e}_{n}") for e in ("first", "last") for c, n in (("c_mktsegment", "segment"), ("c_nationkey", "nation"))]
    return out.select("c_custkey", F.col("group_metadata.count").alias("n"), *ends, F.col("group_metadata.group_id").alias("group_id"))


@query("SELECT c_custkey, count(*) OVER (PARTITION BY c_mktsegment) AS n, dense_rank() OVER (ORDER BY c_mktsegment) AS group_id FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 50 OFFSET 20")
def group_metadata_page(spark, d):
    out = T.grouped_page(t(spark, d, "customer"), ["c_mktsegment"], [{"field": "c_acctbal", "direction": "desc"}], 20, 50)
    return out.select("c_custkey", F.col("group_metadata.count").alias("n"), F.col("group_metadata.group_id").alias("group_id"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderstatus, o_orderdate DESC, o_orderkey LIMIT 40 OFFSET 10")
def fixed_step_order(spark, d):
    """Steps apply in the fixed order whatever order they are given in; grouping sorts by its columns first."""
    steps = {"limit": 40, "offset": 10, "select": ["o_orderkey", "o_orderstatus"], "order": [{"field": "o_orderdate", "direction": "desc"}], "group": ["o_orderstatus"]}
    return T.in_fixed_order(t(spark, d, "orders"), **steps, filter={"greater": [col("o_totalprice"), lit(100000)]})


@query(
    "WITH c AS (SELECT o_totalprice AS p, cume_dist() OVER (ORDER BY o_totalprice) AS k FROM orders)"
    " SELECT CAST(least(ceil(k * 4) - 1, 3) AS INTEGER) AS range, min(p) AS first, max(p) AS last, count(*) AS \"count\" FROM c GROUP BY 1"
)
def cume_dist_quartiles(spark, d):
    return T.cume_dist_ranges(t(spark, d, "orders"), "o_totalprice")


@query(
    "WITH e AS (SELECT max(p_retailprice) - min(p_retailprice) AS x FROM part)"
    " SELECT p_partkey, CAST(floor(p_retailprice / pow(10.0, floor(log10(x)) - 1)) AS BIGINT) AS bucket FROM part, e"
)
def extrema_magnitude_bucket(spark, d):
    return T.extrema(t(spark, d, "part"), "p_retailprice").select("p_partkey", "bucket")


@query(
    "SELECT p_partkey, p_name FROM (SELECT *, CASE WHEN p_name ILIKE 'part' THEN 4 WHEN p_name ILIKE 'part%' THEN 3 WHEN p_name ILIKE '%part%' THEN 2 ELSE 0 END + CASE WHEN p_size = 11 THEN 4 ELSE 0 END AS s FROM part)"
    " WHERE s > 0 ORDER BY s DESC, p_partkey LIMIT 25"
)
def relevance_topk(spark, d):
    spec = {"columns": {"p_name": "PART", "p_size": 11}, "limit": 25}
    return T.apply_transforms(t(spark, d, "part"), [{"type": "search", "spec": spec}, {"type": "select", "spec": ["p_partkey", "p_name"]}])


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 50 LIMIT 25")
def tabular_page(spark, d):
    return T.page(t(spark, d, "orders"), [{"field": "o_totalprice", "direction": "desc"}], 2, 25)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def keyset_page(spark, d):
    return T.after_key(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 500, 100)


@query("SELECT o_orderkey, o_custkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS attempt FROM orders")
def rank_per_partition(spark, d):
    return T.rank_in(t(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], [F.col("o_orderkey")], "attempt")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 1")
def latest_one(spark, d):
    return t(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(1).select("event_id", "event_type")


@query(
    "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(q.e[i] AS DOUBLE))), 6) AS score"
    " FROM embeddings, q WHERE list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(q.e[i] AS DOUBLE))) >= 0.1 ORDER BY score DESC, vec_id LIMIT 10"
)
def vector_topk(spark, d):
    rows = t(spark, d, "embeddings")
    wanted = F.broadcast(rows.where("vec_id = 0").limit(1).select(F.col("embedding").alias("q")))
    scored = rows.crossJoin(wanted).select("vec_id", F.round(S.inner_product(F.col("embedding"), F.col("q")), 6).alias("score"))
    return scored.where("score >= 0.1").orderBy(F.desc("score"), "vec_id").limit(10)


# joins ---------------------------------------------------------------------


@query("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def fk_path_join(spark, d):
    edges = [(t(spark, d, "nation"), "n_nationkey", "c_nationkey"), (t(spark, d, "region"), "r_regionkey", "n_regionkey")]
    return J.fk_path_join(t(spark, d, "customer"), edges).select("c_custkey", "n_name", "r_name")


@query("SELECT DISTINCT n_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def merge_distinct(spark, d):
    return J.merge_distinct(t(spark, d, "supplier"), t(spark, d, "nation"), "s_nationkey", "n_nationkey", ["n_name", "n_regionkey"])


@query("SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2")
def co_occurrence_pairs(spark, d):
    return J.co_occurrence(t(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_join(spark, d):
    return J.semi_join(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000)")
def anti_join(spark, d):
    large = t(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return J.anti_join(t(spark, d, "customer").select("c_custkey"), large, "c_custkey")


@query(
    "WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts, max(value) AS seen FROM events WHERE event_type = 'click' GROUP BY 1, 2)"
    " SELECT event_id, (SELECT arg_max(seen, r.ts) FROM r WHERE r.user_id = l.user_id AND r.ts <= l.ts) AS seen FROM l"
)
def asof_join(spark, d):
    events = t(spark, d, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("seen"))
    return J.as_of_join(left, right, "user_id", "ts", "at", ["seen"], width=7 * 86400).select("event_id", "seen")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderdate <= TIMESTAMP '1997-01-01') AND o_orderdate <= TIMESTAMP '1997-01-01'")
def asof_latest_snapshot(spark, d):
    return J.latest_rows(t(spark, d, "orders"), ["o_custkey"], "o_orderdate", F.lit(datetime(1997, 1, 1))).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT p_partkey, r.name FROM part JOIN (VALUES (900.0, 1200.0, 'low'), (1100.0, 1500.0, 'mid'), (1400.0, 3000.0, 'high')) r(lo, hi, name) ON p_retailprice >= lo AND p_retailprice < hi")
def range_join(spark, d):
    ranges = spark.createDataFrame([(900.0, 1200.0, "low"), (1100.0, 1500.0, "mid"), (1400.0, 3000.0, "high")], "lo double, hi double, name string")
    return J.range_join(t(spark, d, "part"), ranges, "p_retailprice", "lo", "hi", 250.0).select("p_partkey", "name")


@query(
    "WITH RECURSIVE e(id, a, b) AS (VALUES (1, 'customer', 'nation'), (2, 'nation', 'region'), (3, 'orders', 'customer'), (4, 'lineitem', 'orders'), (5, 'supplier', 'nation'), (6, 'lineitem', 'supplier')),"
    " two AS (SELECT id, a, b FROM e UNION ALL SELECT id, b, a FROM e),"
    " r(target, last, depth) AS (SELECT b, id, 1 FROM two WHERE a = 'customer' UNION ALL SELECT two.b, two.id, depth + 1 FROM r JOIN two ON two.a = r.target AND two.id <> r.last WHERE depth < 2)"
    " SELECT DISTINCT target, depth FROM r"
)
def joinable_tables(spark, d):
    edges = [(1, "customer", "nation"), (2, "nation", "region"), (3, "orders", "customer"), (4, "lineitem", "orders"), (5, "supplier", "nation"), (6, "lineitem", "supplier")]
    return J.joinable_tables(spark.createDataFrame(edges, "id int, source string, target string"), "customer").select("target", "depth").distinct()


# scalars ---------------------------------------------------------------------


@query(
    r"SELECT page_id, nullif(regexp_extract(url, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?', 2), '') AS scheme, nullif(regexp_extract(url, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?', 4), '') AS authority,"
    r" nullif(regexp_extract(url, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?', 5), '') AS path, nullif(regexp_extract(url, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?', 7), '') AS query,"
    r" nullif(regexp_extract(url, '^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?', 9), '') AS fragment FROM pages"
)
def uri_parts(spark, d):
    return t(spark, d, "pages").select("page_id", *(S.uri_part(F.col("url"), p).alias(p) for p in S.URI_GROUPS))


@query("SELECT c_custkey, levenshtein(c_mktsegment, 'BUILDINGS') <= floor(length('BUILDINGS') * 0.3) AS close, CAST(levenshtein(c_mktsegment, 'BUILDINGS') AS INTEGER) AS edits FROM customer")
def edit_distance(spark, d):
    return t(spark, d, "customer").select("c_custkey", S.edit_close(F.col("c_mktsegment"), F.lit("BUILDINGS"), 0.3).alias("close"), F.levenshtein("c_mktsegment", F.lit("BUILDINGS")).alias("edits"))


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m') AS month, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders"
)
def truncated_dates(spark, d):
    at = F.col("o_orderdate")
    return t(spark, d, "orders").select("o_orderkey", S.truncated(at, "day").alias("day"), S.truncated(at, "month").alias("month"), S.truncated(at, "year").alias("year"))


@query("SELECT supplier.s_suppkey, round(2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)), 6) AS km FROM supplier JOIN (SELECT s_suppkey AS k, pow(sin(radians(s_nationkey - 10.0) / 2), 2) + cos(radians(10.0)) * cos(radians(s_nationkey)) * pow(sin(radians(s_suppkey % 90 - 20.0) / 2), 2) AS h FROM supplier) ON k = s_suppkey")
def haversine(spark, d):
    km = S.haversine_km(F.lit(10.0), F.lit(20.0), F.col("s_nationkey").cast("double"), (F.col("s_suppkey") % 90).cast("double"))
    return t(spark, d, "supplier").select("s_suppkey", F.round(km, 6).alias("km"))


# time-driven ---------------------------------------------------------------


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id, event_type, value, props) AS r FROM events) WHERE r % 10 = 1")
def sampling_count(spark, d):
    return M.sample_every(t(spark, d, "events"), "user_id", "ts", 10).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM (SELECT *, epoch_ms(ts) - epoch_ms(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) WHERE gap IS NULL OR gap >= 3600000")
def sampling_temporal(spark, d):
    return M.sample_periods(t(spark, d, "events"), "user_id", "ts", 3_600_000).select("event_id", "user_id")


@query("SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS window_start, count(*) AS used, 3 AS \"limit\", CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 + 86400 AS reset, count(*) > 3 AS exceeded FROM events GROUP BY user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT)")
def rate_windows(spark, d):
    return M.rate_windows(t(spark, d, "events"), "user_id", "ts", 86400, F.lit(1), 3)


@query(
    "WITH g AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)"
    " SELECT user_id, count(*) AS n, CAST(coalesce(sum(CASE WHEN gap <= 86400 THEN gap END), 0) AS BIGINT) AS active_seconds, count_if(gap > 86400) AS breaks FROM g GROUP BY 1"
)
def user_segment_stats(spark, d):
    return K.gaps(t(spark, d, "events"), "user_id", "ts", 86400)


@query("SELECT CAST(i AS BIGINT) AS index, CAST(10 + 25 * i AS BIGINT) AS \"from\", CAST(least(35 + 25 * i, 120) AS BIGINT) AS \"to\" FROM range(5) r(i)")
def for_range_slices(spark, d):
    return P.for_range(spark, 10, 120, step=25)


@query("SELECT c_custkey AS customer, c_acctbal AS balance FROM customer WHERE c_acctbal > 5000 ORDER BY c_acctbal DESC, c_custkey LIMIT 40")
def saved_query(spark, d):
    steps = [{"type": "filter", "spec": {"greater": [col("balance"), lit(5000)]}}, {"type": "order", "spec": [{"field": "balance", "direction": "desc"}]}, {"type": "limit", "spec": 40}]
    return P.SavedQuery("customer", {"c_custkey": "customer", "c_acctbal": "balance"}, steps).build(spark, d)


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 7 <> 0")
def update_and_delete(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    changed = R.update_rows(rows, rows.where("c_custkey % 5 = 0").select("c_custkey", F.lit("CHANGED").alias("c_mktsegment")), "c_custkey")
    return R.delete_rows(changed, rows.where("c_custkey % 7 = 0").select("c_custkey"), "c_custkey")


@query("SELECT o_custkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def upsert_latest(spark, d):
    return R.upsert(t(spark, d, "orders"), ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderdate")


# more summaries ----------------------------------------------------------------


@query("SELECT event_type, arg_max(ts, value) AS peak_at, max(value) AS peak, max(ts) AS last FROM (SELECT * FROM events ORDER BY ts DESC, event_id) GROUP BY 1")
def peak_of_series(spark, d):
    return N.peak(t(spark, d, "events"), ["event_type"], "ts", "value")


@query("SELECT l_returnflag, count_if(l_quantity > 10) AS value, count_if(l_quantity > 40) AS value2, CASE WHEN count_if(l_quantity > 10) = 0 THEN NULL ELSE round(count_if(l_quantity > 40) / count_if(l_quantity > 10), 6) END AS ratio FROM lineitem GROUP BY 1")
def ratio_of_filters(spark, d):
    return N.ratio(t(spark, d, "lineitem"), ["l_returnflag"], F.col("l_quantity") > 40, F.col("l_quantity") > 10).withColumn("ratio", F.round("ratio", 6))


@query(
    "WITH r AS (SELECT CAST(ts AS DATE) AS day, count(*) AS runs FROM events WHERE event_type <> 'purchase' GROUP BY 1), f AS (SELECT CAST(ts AS DATE) AS day, count(*) AS failures FROM events WHERE event_type = 'purchase' GROUP BY 1)"
    " SELECT coalesce(r.day, f.day) AS day, coalesce(runs, 0) AS runs, coalesce(failures, 0) AS failures FROM r FULL JOIN f ON r.day = f.day"
)
def failure_counts_per_day(spark, d):
    return N.daily_counts(t(spark, d, "events"), "ts", F.col("event_type") == "purchase")


@query("SELECT year(o_orderdate) AS year, count(*) AS n, round(avg(lines), 6) AS lines FROM (SELECT o_orderdate, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate) GROUP BY 1")
def counts_by_year(spark, d):
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    rows = t(spark, d, "orders").join(lines, "o_orderkey", "left").fillna(0, ["lines"])
    return N.yearly(rows, "o_orderdate", "lines").withColumn("lines", F.round("lines", 6))


@query("SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
def union_all(spark, d):
    return t(spark, d, "region").select("r_name").unionAll(t(spark, d, "nation").select("n_name"))


@query("SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
def set_difference(spark, d):
    return t(spark, d, "customer").select("c_nationkey").subtract(t(spark, d, "supplier").where("s_acctbal > 8000").select("s_nationkey"))


@query("SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1 HAVING count(o_orderkey) > 12")
def related_count_filter(spark, d):
    return J.related_counts(t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders"), "c_custkey", "o_custkey", 13)


@query("SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def ordered_arrays(spark, d):
    return D.ordered_arrays(t(spark, d, "orders"), "o_custkey", "o_orderdate", ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT conv_id, max(turn) AS turn, count(*) AS messages, count_if(role = 'assistant') AS answers FROM conversations GROUP BY 1")
def message_counters(spark, d):
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"), F.count("*").alias("messages"), F.count_if(F.col("role") == "assistant").alias("answers"))


@query("SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3")
def top_n_per_group(spark, d):
    rows = t(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice")
    return T.top_per_group(rows, ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 3)


# filters by kind of value --------------------------------------------------------


@query("SELECT page_id FROM pages WHERE regexp_extract(url, '^([^:/?#]+):', 1) = 'https' AND contains(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1), 'example.org')")
def filter_uri(spark, d):
    tree = {"and": [{"uri_scheme_equals": [col("url"), lit("https")]}, {"uri_authority_contains": [col("url"), lit("example.org")]}]}
    return apply_filter(t(spark, d, "pages"), tree).select("page_id")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR contains(lower(c_mktsegment) || c_nationkey, 'o1')")
def filter_email(spark, d):
    mail = F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@"), F.lower("c_mktsegment"), F.col("c_nationkey").cast("string"), F.lit(".org"))
    tree = {"or": [{"and": [{"email_domain_contains": [col("mail"), lit("building")]}, {"not_null": [col("mail")]}]}, {"email_domain_contains": [col("mail"), lit("o1")]}]}
    return apply_filter(t(spark, d, "customer").withColumn("mail", mail), tree).select("c_custkey")


@query(
    "WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '[]' WHEN 1 THEN '[\"' || event_type || '\"]' ELSE '[\"a\", \"' || event_type || '\", \"b\"]' END AS tags FROM events)"
    " SELECT event_id FROM e WHERE json_array_length(tags) > 0 AND json_array_length(tags) <= 3 AND list_contains(json_extract_string(tags, '$[*]'), 'click')"
)
def filter_json_array(spark, d):
    tags = F.expr("CASE event_id % 3 WHEN 0 THEN '[]' WHEN 1 THEN concat('[\"', event_type, '\"]') ELSE concat('[\"a\", \"', event_type, '\", \"b\"]') END")
    tree = {"and": [{"json_array_not_empty": [col("tags")]}, {"json_array_length_less_or_equal": [col("tags"), lit(3)]}, {"json_array_contains": [col("tags"), lit('["click"]')]}]}
    return apply_filter(t(spark, d, "events").withColumn("tags", tags), tree).select("event_id")


@query("SELECT p_partkey FROM part WHERE len(string_split(p_name, ' ')) >= 2 AND list_contains(string_split(p_name, ' '), 'ring')")
def filter_array(spark, d):
    tree = {"and": [{"array_length_greater_or_equal": [col("words"), lit(2)]}, {"array_not_empty": [col("words")]}, {"array_contains": [col("words"), lit("ring")]}]}
    return apply_filter(t(spark, d, "part").withColumn("words", F.split("p_name", " ")), tree).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE (p_name ILIKE '%ring%' OR p_type ILIKE '%ring%') AND (p_name ILIKE '%econ%' OR p_type ILIKE '%econ%')")
def any_term_search(spark, d):
    return apply_filter(t(spark, d, "part"), any_term(["p_name", "p_type"], ["RING", "econ"])).select("p_partkey")


@query("SELECT doc_id FROM documents WHERE text IS NULL OR text = '' OR lang IS NULL OR CASE WHEN source = 'src0' THEN '' ELSE source END = ''")
def missing_audit(spark, d):
    docs = t(spark, d, "documents").withColumn("source", F.when(F.col("source") != "src0", F.col("source")))
    return docs.where(missing(F.col("text")) | missing(F.col("lang")) | missing(F.col("source"))).select("doc_id")


# summaries, series and states ----------------------------------------------------


@query(
    "WITH s AS (SELECT event_type, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s, month(ts) - 1 AS m FROM events),"
    " a AS (SELECT event_type, atan2(avg(sin(s * 2 * pi() / 86400)), avg(cos(s * 2 * pi() / 86400))) AS a, atan2(avg(sin(m * 2 * pi() / 12)), avg(cos(m * 2 * pi() / 12))) AS b FROM s GROUP BY 1),"
    " r AS (SELECT event_type, CAST(round((CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END) * 86400 / (2 * pi())) AS BIGINT) % 86400 AS s, CAST(round((CASE WHEN b < 0 THEN b + 2 * pi() ELSE b END) * 12 / (2 * pi())) AS INTEGER) % 12 + 1 AS peak_month FROM a)"
    " SELECT event_type, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS peak_time, peak_month FROM r"
)
def peak_times(spark, d):
    made = [{"function": f, "column": "ts", "alias": f} for f in ("peak_time", "peak_month")]
    return A.summarize(t(spark, d, "events"), ["event_type"], made)


@query("SELECT user_id, sum(CASE WHEN event_id % 4 = 0 THEN -1 ELSE 1 END * CAST(round(value * 100) AS BIGINT))::BIGINT AS sum, sum(CASE WHEN event_id % 4 = 0 THEN -1 ELSE 1 END)::BIGINT AS n FROM events GROUP BY 1 HAVING sum(CASE WHEN event_id % 4 = 0 THEN -1 ELSE 1 END) <> 0")
def retracted_statistics(spark, d):
    rows = t(spark, d, "events").select("user_id", F.round(F.col("value") * 100).cast("long").alias("cents"), F.when(F.col("event_id") % 4 == 0, -1).otherwise(1).alias("sign"))
    return M.signed_statistics(rows, ["user_id"], "cents", "sign")


@query(
    "WITH o AS (SELECT l_returnflag, l_linenumber AS partition, max(l_orderkey) % 1000 AS committed, max(l_partkey) % 1000 AS log_end FROM lineitem GROUP BY 1, 2), l AS (SELECT *, greatest(0, log_end - committed) AS lag FROM o)"
    " SELECT l_returnflag, sum(lag)::BIGINT AS total_lag, max(lag) AS max_lag, (SELECT partition FROM l x WHERE x.l_returnflag = l.l_returnflag ORDER BY lag DESC, partition LIMIT 1) AS max_partition FROM l GROUP BY 1"
)
def consumer_lags(spark, d):
    offsets = t(spark, d, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").alias("partition")).agg((F.max("l_orderkey") % 1000).alias("committed"), (F.max("l_partkey") % 1000).alias("log_end"))
    return M.consumer_lag(offsets, ["l_returnflag"])


@query(
    "SELECT conv_id, turn, row_number() OVER w AS message, CASE WHEN role = 'assistant' THEN sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) ELSE -1 END::BIGINT AS error"
    " FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)"
)
def running_errors(spark, d):
    out = C.running_errors(t(spark, d, "conversations"), "conv_id", ["turn", "role", "text"], F.col("role") == "assistant")
    return out.select("conv_id", "turn", F.col("message").cast("long").alias("message"), F.col("error").cast("long").alias("error"))


@query(
    "WITH b AS (SELECT CASE WHEN event_type IN ('click', 'purchase') THEN event_type ELSE 'remainder' END AS \"group\", CAST(floor(epoch_ms(ts) / 86400000.0) AS BIGINT) * 86400000 AS bucket FROM events),"
    " s AS (SELECT unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b), 86400000)) AS bucket)"
    " SELECT g.\"group\", s.bucket, count(b.bucket) AS n FROM s CROSS JOIN (SELECT DISTINCT \"group\" FROM b) g LEFT JOIN b ON b.bucket = s.bucket AND b.\"group\" = g.\"group\" GROUP BY 1, 2"
)
def series_with_remainder(spark, d):
    return N.series_by(t(spark, d, "events"), "ts", 86_400_000, "event_type", ["click", "purchase"])


@query("SELECT CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS day, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 NULLS LAST")
def date_groups_nulls_last(spark, d):
    return N.date_groups(t(spark, d, "orders").withColumn("at", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))), "at")


@query("SELECT l_suppkey, median(l_quantity) AS middle FROM lineitem GROUP BY 1")
def median_by_counts(spark, d):
    return A.counted_median(t(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "middle")


@query("WITH c AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, l_quantity AS common FROM c QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_quantity) = 1")
def mode_by_counts(spark, d):
    return A.counted_mode(t(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "common")


@query(
    "SELECT r.a AS \"from\", r.b AS \"to\", count(o_orderkey) AS n FROM (VALUES (TIMESTAMP '1990-01-01', TIMESTAMP '1991-01-01'), (TIMESTAMP '1991-01-01', TIMESTAMP '1996-07-01'), (TIMESTAMP '1996-07-01', TIMESTAMP '1997-01-01')) r(a, b)"
    " LEFT JOIN orders ON o_orderdate >= r.a AND o_orderdate < r.b GROUP BY 1, 2"
)
def interval_counts(spark, d):
    edges = [datetime(1990, 1, 1), datetime(1991, 1, 1), datetime(1996, 7, 1), datetime(1997, 1, 1)]
    return C.interval_counts(t(spark, d, "orders"), "o_orderdate", edges)


@query("SELECT i, i * i AS square FROM range(12) r(i)")
def loop_rows(spark, d):
    return P.loop(spark, 12).withColumn("square", F.col("i") * F.col("i"))


@query(
    "WITH h AS (SELECT user_id, event_type FROM events WHERE event_id % 10 = 0) SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.user_id = e.user_id AND h.event_type = e.event_type) THEN 75"
    " WHEN EXISTS (SELECT 1 FROM h WHERE h.user_id = e.user_id) THEN 50 ELSE 0 END AS confidence FROM events e WHERE event_id % 2 = 1"
)
def failure_confidence(spark, d):
    events = t(spark, d, "events")
    return C.history_confidence(events.where("event_id % 2 = 1"), events.where("event_id % 10 = 0"), ["user_id", "event_type"]).select("event_id", "confidence")


@query(
    "SELECT l_suppkey, CASE WHEN count_if(l_returnflag = 'R') <= 0.3 * count(*) OR count(*) % 100 = 0 THEN 'known issue' ELSE 'needs investigation' END AS label,"
    " CASE WHEN count_if(l_returnflag = 'R') <= 0.3 * count(*) OR count(*) % 100 = 0 THEN count(*) % 100 + CASE WHEN count(*) % 100 = 0 THEN 100 ELSE 0 END ELSE least(count(*) % 100, 90) END AS confidence FROM lineitem GROUP BY 1"
)
def failure_triage(spark, d):
    n = F.count("*") % 100
    rows = t(spark, d, "lineitem").groupBy("l_suppkey").agg((F.count_if(F.col("l_returnflag") == "R") * 5).alias("failures"), (F.count("*") * 3).alias("jobs"), F.when(n == 0, 100).otherwise(n).alias("confidence"))
    return C.triage(rows, "l_suppkey", "failures", "jobs", "confidence")


@query("SELECT c_custkey, list_has_any([c_nationkey, CAST(c_custkey % 25 AS INTEGER)], [3, 5, 11]) AS hit FROM customer")
def any_pair_of_arrays(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", F.array(F.col("c_nationkey"), (F.col("c_custkey") % 25).cast("int")).alias("a"), F.array(F.lit(3), F.lit(5), F.lit(11)).alias("b"))
    return rows.select("c_custkey", D.any_pair("a", "b", lambda x, y: x == y).alias("hit"))


# more scalars ------------------------------------------------------------------------


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS at, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def iso_instants(spark, d):
    at = F.col("o_orderdate")
    return t(spark, d, "orders").select("o_orderkey", S.iso_instant(at).alias("at"), S.iso_instant(at, time=False).alias("day"))


@query(
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 3 = 1 THEN NULL ELSE TRY_CAST(strftime(o_orderdate, '%Y') || '-02-30' AS DATE) END AS day FROM orders"
)
def strict_dates(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 3 == 0, day).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit("x"))).otherwise(F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-02-30")))
    return t(spark, d, "orders").select("o_orderkey", S.strict_date(text).alias("day"))


@query(
    "SELECT o_orderkey, CAST(CASE WHEN isodow(o_orderdate) = 6 THEN CAST(o_orderdate AS DATE) + 2 WHEN isodow(o_orderdate) = 7 THEN CAST(o_orderdate AS DATE) + 1 ELSE CAST(o_orderdate AS DATE) END AS DATE) AS base,"
    " list_filter(list_transform(range(1, 30), lambda i: base + CAST(i AS INTEGER)), lambda x: isodow(x) < 6)[7] AS due FROM orders"
)
def due_dates(spark, d):
    start = F.to_date("o_orderdate")
    base = F.date_add(start, F.greatest(F.lit(0), F.lit(7) - F.weekday(start)).cast("int") * (F.weekday(start) >= 5).cast("int"))
    return t(spark, d, "orders").select("o_orderkey", base.alias("base"), S.due_date(start, F.lit(7)).alias("due"))


@query("SELECT event_id, json_type(CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '[' || props || ']' ELSE '7' END) = 'ARRAY' AS is_array, json_type(CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '[' || props || ']' ELSE '7' END) = 'OBJECT' AS is_object FROM events")
def json_kinds(spark, d):
    text = F.expr("CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN concat('[', props, ']') ELSE '7' END")
    return t(spark, d, "events").select("event_id", S.is_json_array(text).alias("is_array"), S.is_json_object(text).alias("is_object"))


@query("SELECT page_id, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) SIMILAR TO '.*[.](org|net)' AS known FROM pages")
def known_tld(spark, d):
    return t(spark, d, "pages").select("page_id", S.has_known_tld(S.uri_part(F.col("url"), "authority"), ["ORG", ".net"]).alias("known"))


@query("SELECT c_nationkey, sum(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE AS total FROM customer GROUP BY 1")
def downcast_sum(spark, d):
    rows = t(spark, d, "customer").select("c_nationkey", S.downcast(F.format_string("%.2f", "c_acctbal"), "money").alias("amount"))
    return A.summarize(rows, ["c_nationkey"], [{"function": "sum", "column": "amount", "alias": "total"}]).withColumn("total", F.col("total").cast("double"))


@query(
    "WITH c AS (SELECT p_partkey, w, levenshtein(left(p_type, 5), w) AS e FROM part, (VALUES ('ECONO'), ('LARGE'), ('SMALL'), ('STAND')) v(w) WHERE levenshtein(left(p_type, 5), w) <= floor(length(left(p_type, 5)) * 0.6))"
    " SELECT part.p_partkey, (SELECT w FROM c WHERE c.p_partkey = part.p_partkey ORDER BY e, w LIMIT 1) AS nearest FROM part"
)
def suggestions(spark, d):
    return t(spark, d, "part").select("p_partkey", S.suggestion(F.substring("p_type", 1, 5), ["STAND", "ECONO", "SMALL", "LARGE"], 0.6).alias("nearest"))


@query("SELECT page_id, url || '<U+01F600>' || 'é' AS safe FROM pages")
def astral_escape(spark, d):
    return t(spark, d, "pages").select("page_id", S.escape_astral(F.concat("url", F.lit("😀é"))).alias("safe"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS message FROM customer")
def log_parts(spark, d):
    line = F.when(F.col("c_custkey") % 2 == 0, F.concat_ws(" | ", "c_name", "c_nationkey", "c_mktsegment")).otherwise(F.col("c_name"))
    return t(spark, d, "customer").select("c_custkey", S.log_part(line).alias("message"))


@query("SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents")
def folded_text(spark, d):
    return t(spark, d, "documents").select("doc_id", S.folded(F.col("text")).alias("folded"))


@query("SELECT o_orderkey, o_orderstatus AS status, NULL::VARCHAR AS shape, 7::BIGINT AS level FROM orders")
def columns_added(spark, d):
    rows = T.duplicate_column(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "status")
    return T.with_column(T.duplicate_column(rows, "o_orderstatus", "shape", data=False), "level", "bigint", 7).drop("o_orderstatus")
