"""Registered queries of the table engine, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import buckets, cleans, formula
from .functions import text as T
from .operators import charts, compare, filters, fuzzy_index, models, neighbours, pivot, profile, review, scorecard, sensitive, timeseries, transforms
from .operators.aggregate import (
    BinEdges, BinQuantile, BinWidth, Cohort, DatePart, Measure, Since, Time, Value, View, Where, aggregate, partial_periods, post, totals,
)
from .operators.durable import shared_path
from .operators.order import parts_of
from .operators.profile import Rule

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(column: str, digits: int = 2):
    return F.round(F.col(f"`{column}`"), digits).alias(column)


# -- aggregation: dimensions --------------------------------------------------


@query("""SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 2) AS price,
round(sum(l_extendedprice * (1 - l_discount)) / count(*), 2) AS revenue_per_row FROM lineitem
WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def agg_value_dims(spark, d):
    li = t(spark, d, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    v = View(
        (Value("l_returnflag"), Value("l_linestatus")),
        (Measure("count", name="n"), Measure("sum", "l_quantity", "qty"), Measure("mean", "l_extendedprice", "price"), Measure("expr", name="revenue_per_row", expr="sum([net]) / count(*)")),
        names=("flag", "status"), filters=(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"),),
    )
    return aggregate(li, v).select("flag", "status", "n", r("qty"), r("price"), r("revenue_per_row"))


@query("""WITH g AS (SELECT date_trunc('month', o_orderdate) AS b, count(*) AS n, sum(o_totalprice) AS s FROM orders WHERE o_orderpriority LIKE '1%' AND month(o_orderdate) <> 3 GROUP BY 1),
c AS (SELECT unnest(generate_series((SELECT CAST(min(b) AS TIMESTAMP) FROM g), (SELECT CAST(max(b) AS TIMESTAMP) FROM g), INTERVAL 1 MONTH)) AS b)
SELECT strftime(c.b, '%Y-%m') AS month, coalesce(n, 0) AS n, round(coalesce(s, 0), 2) AS total FROM c LEFT JOIN g ON c.b = g.b""")
def agg_time_month_fill_zero(spark, d):
    o = t(spark, d, "orders").where("o_orderpriority like '1%' and month(o_orderdate) <> 3")
    v = View((Time("o_orderdate", "month"),), (Measure("count", name="n"), Measure("sum", "o_totalprice", "total")), fill="zero", names=("b",))
    return aggregate(o, v).select(buckets.bucket_label(F.col("b"), "month").alias("month"), "n", r("total"))


@query("""WITH g AS (SELECT date_trunc('day', ts) AS b, count(*) AS n, avg(value) AS m FROM events WHERE day(ts) % 3 <> 0 GROUP BY 1),
c AS (SELECT unnest(generate_series((SELECT CAST(min(b) AS TIMESTAMP) FROM g), (SELECT CAST(max(b) AS TIMESTAMP) FROM g), INTERVAL 1 DAY)) AS b)
SELECT strftime(c.b, '%Y-%m-%d') AS day, last_value(n IGNORE NULLS) OVER w AS n, round(last_value(m IGNORE NULLS) OVER w, 4) AS m FROM c LEFT JOIN g ON c.b = g.b
WINDOW w AS (ORDER BY c.b ROWS UNBOUNDED PRECEDING)""")
def agg_time_carry(spark, d):
    e = t(spark, d, "events").where("day(ts) % 3 <> 0")
    v = View((Time("ts", "day"),), (Measure("count", name="n"), Measure("mean", "value", "m")), fill="carry", names=("b",))
    return aggregate(e, v).select(buckets.bucket_label(F.col("b"), "day").alias("day"), "n", r("m", 4))


@query("""WITH g AS (SELECT date_trunc('day', ts) AS b, count(*) AS n FROM events WHERE day(ts) % 3 <> 0 GROUP BY 1),
c AS (SELECT unnest(generate_series((SELECT CAST(min(b) AS TIMESTAMP) FROM g), (SELECT CAST(max(b) AS TIMESTAMP) FROM g), INTERVAL 1 DAY)) AS b)
SELECT strftime(c.b, '%Y-%m-%d') AS day, n FROM c LEFT JOIN g ON c.b = g.b""")
def agg_time_gaps(spark, d):
    e = t(spark, d, "events").where("day(ts) % 3 <> 0")
    v = View((Time("ts", "day"),), (Measure("count", name="n"),), fill="gaps", names=("b",))
    return aggregate(e, v).select(buckets.bucket_label(F.col("b"), "day").alias("day"), "n")


@query("""SELECT strftime(time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS b, count(*) AS n, round(sum(value), 2) AS s FROM events GROUP BY 1""")
def agg_every_15min(spark, d):
    v = View((Time("ts", "minute", 15),), (Measure("count", name="n"), Measure("sum", "value", "s")), names=("b",))
    return aggregate(t(spark, d, "events"), v).select(buckets.bucket_label(F.col("b"), "minute").alias("b"), "n", r("s"))


@query("""SELECT strftime(date_trunc('week', o_orderdate + INTERVAL 1 DAY) - INTERVAL 1 DAY, '%Y-%m-%d') AS week, count(*) AS n FROM orders GROUP BY 1""")
def agg_week_sunday(spark, d):
    v = View((Time("o_orderdate", "week", week_start=7),), (Measure("count", name="n"),), names=("b",))
    return aggregate(t(spark, d, "orders"), v).select(buckets.bucket_label(F.col("b"), "week").alias("week"), "n")


@query("""SELECT 'FY' || year(o_orderdate - INTERVAL 6 MONTH) || ' Q' || quarter(o_orderdate - INTERVAL 6 MONTH) AS q, count(*) AS n, round(sum(o_totalprice), 2) AS s
FROM (SELECT date_trunc('month', o_orderdate) AS o_orderdate, o_totalprice FROM orders) GROUP BY 1""")
def agg_fiscal_quarter(spark, d):
    v = View((Time("o_orderdate", "quarter", fiscal_start=7),), (Measure("count", name="n"), Measure("sum", "o_totalprice", "s")), names=("b",))
    return aggregate(t(spark, d, "orders"), v).select(buckets.bucket_label(F.col("b"), "quarter", 7).alias("q"), "n", r("s"))


@query("""SELECT strftime(date_trunc('day', ts + INTERVAL 330 MINUTE), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1""")
def agg_time_zone(spark, d):
    v = View((Time("ts", "day", zone="Asia/Kolkata"),), (Measure("count", name="n"),), names=("b",))
    return aggregate(t(spark, d, "events"), v).select(buckets.bucket_label(F.col("b"), "day").alias("day"), "n")


_PART_SQL = """SELECT 'quarter' AS part, 'Q' || quarter(ts) AS label, count(*) AS n FROM events GROUP BY 2
UNION ALL SELECT 'month', strftime(ts, '%b'), count(*) FROM events GROUP BY 2
UNION ALL SELECT 'week', 'W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0'), count(*) FROM events GROUP BY 2
UNION ALL SELECT 'dom', lpad(CAST(day(ts) AS VARCHAR), 2, '0'), count(*) FROM events GROUP BY 2
UNION ALL SELECT 'dow', strftime(ts, '%a'), count(*) FROM events GROUP BY 2
UNION ALL SELECT 'hour', lpad(CAST(hour(ts) AS VARCHAR), 2, '0'), count(*) FROM events GROUP BY 2
UNION ALL SELECT 'minute', lpad(CAST(minute(ts) AS VARCHAR), 2, '0'), count(*) FROM events GROUP BY 2
UNION ALL SELECT 'second', lpad(CAST(second(ts) AS VARCHAR), 2, '0'), count(*) FROM events GROUP BY 2"""


@query(_PART_SQL)
def agg_date_parts(spark, d):
    e = t(spark, d, "events")
    # One scan: the eight labels of a row are exploded before counting.
    parts = F.array(*[F.struct(F.lit(p).alias("part"), buckets.date_part(F.col("ts"), p)[0].alias("label")) for p in buckets.PARTS])
    return e.select(F.inline(parts)).groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT quarter(o_orderdate) AS q, count(*) AS n FROM orders GROUP BY 1""")
def agg_date_part_dim(spark, d):
    v = View((DatePart("o_orderdate", "quarter"),), (Measure("count", name="n"),), names=("q",))
    return aggregate(t(spark, d, "orders"), v).select(F.substring("q", 2, 1).cast("bigint").alias("q"), "n")


@query("""SELECT CAST(least(floor(p_retailprice / 100) - floor((SELECT min(p_retailprice) FROM part) / 100), 1023) AS INTEGER) AS bin, count(*) AS n FROM part GROUP BY 1""")
def agg_bin_width(spark, d):
    return aggregate(t(spark, d, "part"), View((BinWidth("p_retailprice", 100.0),), (Measure("count", name="n"),), names=("bin",)))


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS e FROM lineitem)
SELECT CAST((l_extendedprice >= e[1])::INT + (l_extendedprice >= e[2])::INT + (l_extendedprice >= e[3])::INT AS INTEGER) AS bin, count(*) AS n, round(avg(l_quantity), 4) AS q FROM lineitem, q GROUP BY 1""")
def agg_bin_quantile(spark, d):
    return aggregate(t(spark, d, "lineitem"), View((BinQuantile("l_extendedprice", 4),), (Measure("count", name="n"), Measure("mean", "l_quantity", "q")), names=("bin",))).select("bin", "n", r("q", 4))


@query("""SELECT CAST(CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 25 THEN 1 ELSE 2 END AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1""")
def agg_bin_edges(spark, d):
    return aggregate(t(spark, d, "lineitem"), View((BinEdges("l_quantity", (1, 10, 25, 50)),), (Measure("count", name="n"),), names=("bin",)))


@query("""WITH f AS (SELECT *, min(date_trunc('quarter', o_orderdate)) OVER (PARTITION BY o_custkey) AS c FROM orders)
SELECT year(c) || ' Q' || quarter(c) AS cohort, count(*) AS n, count(DISTINCT CAST(o_custkey AS VARCHAR)) AS customers FROM f GROUP BY 1""")
def agg_cohort(spark, d):
    v = View((Cohort("o_custkey", "o_orderdate", "quarter"),), (Measure("count", name="n"), Measure("distinct", "o_custkey", "customers")), names=("c",))
    return aggregate(t(spark, d, "orders"), v).select(buckets.bucket_label(F.col("c"), "quarter").alias("cohort"), "n", "customers")


@query("""WITH f AS (SELECT year(ts) * 372 AS y, datediff('day', DATE '1970-01-05', CAST(ts AS DATE)) AS p, user_id FROM events),
g AS (SELECT p - min(p) OVER (PARTITION BY user_id) AS k FROM f) SELECT 'P' || k AS since, count(*) AS n FROM g GROUP BY 1""")
def agg_since(spark, d):
    return aggregate(t(spark, d, "events"), View((Since("user_id", "ts", "day"),), (Measure("count", name="n"),), names=("since",)))


# -- aggregation: measures ----------------------------------------------------


@query("""SELECT l_returnflag AS flag, round(median(l_extendedprice), 4) AS med, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(l_extendedprice, 0.999), 4) AS p999 FROM lineitem GROUP BY 1""")
def agg_percentiles(spark, d):
    v = View((Value("l_returnflag"),), (Measure("median", "l_extendedprice", "med"), Measure("p95", "l_extendedprice", "p95"), Measure("p99.9", "l_extendedprice", "p999")), names=("flag",))
    return aggregate(t(spark, d, "lineitem"), v).select("flag", r("med", 4), r("p95", 4), r("p999", 4))


@query("""WITH c AS (SELECT l_returnflag AS flag, CAST(l_quantity AS INTEGER)::VARCHAR AS v, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT flag, v AS mode FROM c QUALIFY row_number() OVER (PARTITION BY flag ORDER BY n DESC, v) = 1""")
def agg_mode(spark, d):
    li = t(spark, d, "lineitem").withColumn("q", F.col("l_quantity").cast("int").cast("string"))
    return aggregate(li, View((Value("l_returnflag"),), (Measure("mode", "q", "mode"),), names=("flag",)))


@query("""SELECT event_type AS kind, round(arg_min(value, event_id), 4) AS first, round(arg_max(value, event_id), 4) AS last FROM events GROUP BY 1""")
def agg_first_last(spark, d):
    v = View((Value("event_type"),), (Measure("first", "value", "first", order="event_id"), Measure("last", "value", "last", order="event_id")), names=("kind",))
    return aggregate(t(spark, d, "events"), v).select("kind", r("first", 4), r("last", 4))


@query("""SELECT l_linestatus AS status, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS wmean, round(sum(l_discount * l_quantity), 2) AS wsum FROM lineitem GROUP BY 1""")
def agg_weighted(spark, d):
    v = View((Value("l_linestatus"),), (Measure("wmean", "l_discount", "wmean", weight="l_quantity"), Measure("wsum", "l_discount", "wsum", weight="l_quantity")), names=("status",))
    return aggregate(t(spark, d, "lineitem"), v).select("status", r("wmean", 6), r("wsum"))


@query("""SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') AS done, round(coalesce(sum(o_totalprice) FILTER (o_totalprice BETWEEN 1000 AND 100000), 0), 2) AS mid,
round(sum(o_totalprice) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus = 'F'), 2) AS mean_done FROM orders GROUP BY 1""")
def agg_conditional(spark, d):
    done = Where("o_orderstatus", values=("F",))
    v = View((Value("o_orderpriority"),), (Measure("count", name="done", where=done), Measure("sum", "o_totalprice", "mid", where=Where("o_totalprice", low=1000, high=100000)), Measure("expr", name="mean_done", expr="sum(o_totalprice) / count(*)", where=done)), names=("priority",))
    return aggregate(t(spark, d, "orders"), v).select("priority", "done", r("mid"), r("mean_done"))


@query("""SELECT l_shipdate IS NOT NULL AS shipped, count(DISTINCT l_partkey) AS parts, round(stddev_samp(l_quantity), 4) AS sd, round(var_samp(l_quantity), 4) AS var, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY 1""")
def agg_distinct_spread(spark, d):
    li = t(spark, d, "lineitem").withColumn("shipped", F.col("l_shipdate").isNotNull())
    v = View((Value("shipped"),), (Measure("distinct", "l_partkey", "parts"), Measure("stddev", "l_quantity", "sd"), Measure("variance", "l_quantity", "var"), Measure("min", "l_tax", "lo"), Measure("max", "l_tax", "hi")), names=("shipped",))
    return aggregate(li, v).select(F.col("shipped").cast("boolean"), "parts", r("sd", 4), r("var", 4), "lo", "hi")


@query("""SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s, round(median(o_totalprice), 2) AS med FROM orders""")
def agg_totals(spark, d):
    v = View((Value("o_orderstatus"),), (Measure("count", name="n"), Measure("sum", "o_totalprice", "s"), Measure("median", "o_totalprice", "med")))
    return totals(t(spark, d, "orders"), v).select("n", r("s"), r("med"))


@query("""SELECT CAST(l_partkey AS VARCHAR) AS part, count(*) AS n, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY 1 ORDER BY sum(l_quantity) DESC, part LIMIT 50""")
def agg_topn(spark, d):
    v = View((Value("l_partkey"),), (Measure("count", name="n"), Measure("sum", "l_quantity", "s")), sort=("s", "desc"), limit=50, names=("part",))
    return aggregate(t(spark, d, "lineitem"), v).select("part", "n", r("s"))


@query("""WITH g AS (SELECT date_trunc('month', o_orderdate) AS b, count(*) AS n, min(o_orderdate) AS f FROM orders GROUP BY 1), e AS (SELECT min(b) AS lo, max(b) AS hi, median(n) AS mid, count(*) AS k FROM g)
SELECT strftime(b, '%Y-%m') AS month, n, (b = lo AND CAST(f AS DATE) > CAST(b AS DATE)) AS starts_inside, (b = hi AND TIMESTAMP '2001-08-02' < b + INTERVAL 1 MONTH) AS not_over, (k >= 4 AND mid >= 4 AND n < 0.5 * mid) AS thin FROM g, e""")
def agg_partial_periods(spark, d):
    out = partial_periods(t(spark, d, "orders"), "o_orderdate", Time("o_orderdate", "month"), "2001-08-02 00:00:00")
    return out.select(buckets.bucket_label(F.col("bucket"), "month").alias("month"), "n", "starts_inside", "not_over", "thin")


# -- post operations ----------------------------------------------------------


def _monthly(spark, d):
    v = View((Time("o_orderdate", "month"),), (Measure("sum", "o_totalprice", "s"),), names=("b",))
    return aggregate(t(spark, d, "orders"), v)


_MONTHLY = "WITH g AS (SELECT date_trunc('month', o_orderdate) AS b, sum(o_totalprice) AS s FROM orders GROUP BY 1) "


def _labelled(df, *cols):
    return df.select(buckets.bucket_label(F.col("b"), "month").alias("month"), *cols)


@query(_MONTHLY + "SELECT strftime(b, '%Y-%m') AS month, round(avg(s) OVER (ORDER BY b ROWS 2 PRECEDING), 2) AS x FROM g")
def post_rolling(spark, d):
    return _labelled(post(_monthly(spark, d), "rolling", "s", "b", name="x"), r("x"))


@query(_MONTHLY + "SELECT strftime(b, '%Y-%m') AS month, round(sum(s) OVER (ORDER BY b), 2) AS x FROM g")
def post_cumulative(spark, d):
    return _labelled(post(_monthly(spark, d), "cumulative", "s", "b", name="x"), r("x"))


@query(_MONTHLY + "SELECT strftime(b, '%Y-%m') AS month, round(s - lag(s) OVER (ORDER BY b), 2) AS x FROM g")
def post_diff(spark, d):
    return _labelled(post(_monthly(spark, d), "diff", "s", "b", name="x"), r("x"))


@query(_MONTHLY + "SELECT strftime(b, '%Y-%m') AS month, round((s - lag(s) OVER w) / lag(s) OVER w, 6) AS x FROM g WINDOW w AS (ORDER BY b)")
def post_pct_change(spark, d):
    return _labelled(post(_monthly(spark, d), "pctChange", "s", "b", name="x"), r("x", 6))


@query(_MONTHLY + "SELECT strftime(b, '%Y-%m') AS month, round(s / (SELECT sum(o_totalprice) FROM orders), 8) AS x FROM g")
def post_pct_total(spark, d):
    whole = t(spark, d, "orders").agg(F.sum("o_totalprice").alias("_t"))
    return _labelled(post(_monthly(spark, d).join(F.broadcast(whole)), "pctTotal", "s", "b", total=F.col("_t"), name="x"), r("x", 8))


@query(_MONTHLY + "SELECT strftime(b, '%Y-%m') AS month, CAST(row_number() OVER (ORDER BY s DESC, b) AS INTEGER) AS x FROM g")
def post_rank(spark, d):
    return _labelled(post(_monthly(spark, d), "rank", "s", "b", name="x"), "x")


@query("""WITH g AS (SELECT date_trunc('month', o_orderdate) AS b, o_orderstatus AS k, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2)
SELECT strftime(g.b, '%Y-%m') AS month, g.k AS status, round((g.s - p.s) / p.s, 6) AS x FROM g LEFT JOIN g p ON p.k = g.k AND p.b + INTERVAL 1 YEAR = g.b""")
def post_yoy(spark, d):
    v = View((Time("o_orderdate", "month"), Value("o_orderstatus")), (Measure("sum", "o_totalprice", "s"),), names=("b", "status"))
    return _labelled(post(aggregate(t(spark, d, "orders"), v), "yoy", "s", "b", by=("status",), name="x"), "status", r("x", 6))


# -- pivots and reshaping -----------------------------------------------------


@query("""SELECT coalesce(o_orderstatus, '(total)') AS o_orderstatus, coalesce(o_orderpriority, '(total)') AS o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS s
FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def pivot_margins(spark, d):
    return pivot.pivot_long(t(spark, d, "orders"), ["o_orderstatus"], ["o_orderpriority"], [Measure("count", name="n"), Measure("sum", "o_totalprice", "s")]).select("o_orderstatus", "o_orderpriority", "n", r("s"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS share FROM orders GROUP BY 1, 2""")
def pivot_pct(spark, d):
    return pivot.pivot_percent(t(spark, d, "orders"), ["o_orderstatus"], ["o_orderpriority"], Measure("count", name="n"), "row").select("o_orderstatus", "o_orderpriority", "n", r("share", 6))


@query("""SELECT o_orderpriority, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS F, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS O, round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS P FROM orders GROUP BY 1""")
def pivot_wide(spark, d):
    out = pivot.pivot_wide(t(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", Measure("sum", "o_totalprice"), ["F", "O", "P"])
    return out.select("o_orderpriority", r("F"), r("O"), r("P"))


@query("""SELECT o_orderpriority, round(sum(o_totalprice) / count(o_totalprice), 2) AS m FROM orders GROUP BY 1""")
def pivot_lambda(spark, d):
    from .operators.aggregate import lambda_expression

    m = Measure("expr", name="m", expr=lambda_expression("lambda x: x.sum() / x.count()", "o_totalprice"))
    return aggregate(t(spark, d, "orders"), View((Value("o_orderpriority"),), (m,), names=("o_orderpriority",))).select("o_orderpriority", r("m"))


@query("""SELECT user_id, arg_min(value, event_id) FILTER (event_type = 'click') AS click, arg_min(value, event_id) FILTER (event_type = 'view') AS view FROM events GROUP BY 1""")
def spread_first(spark, d):
    return pivot.spread(t(spark, d, "events"), ["user_id"], "event_type", "value", "first", "event_id", ["click", "view"])


@query("""SELECT user_id, round(sum(value) FILTER (event_type = 'click'), 2) AS click, round(sum(value) FILTER (event_type = 'view'), 2) AS view FROM events GROUP BY 1""")
def spread_sum(spark, d):
    return pivot.spread(t(spark, d, "events"), ["user_id"], "event_type", "value", "sum", "event_id", ["click", "view"]).select("user_id", r("click"), r("view"))


@query("""SELECT s_suppkey, 's_name' AS variable, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey', CAST(s_nationkey AS VARCHAR) FROM supplier""")
def melt(spark, d):
    return pivot.melt(t(spark, d, "supplier"), ["s_suppkey"], ["s_name", "s_nationkey"])


@query("""SELECT p_partkey, unnest(string_split(p_brand, '#')) AS p_brand FROM part""")
def explode(spark, d):
    return pivot.explode_column(t(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "#")


@query("""SELECT p_partkey, p_brand, coalesce(string_split(p_brand, '#')[1], '') AS p_brand_1, coalesce(string_split(p_brand, '#')[2], '') AS p_brand_2, coalesce(string_split(p_brand, '#')[3], '') AS p_brand_3 FROM part""")
def split(spark, d):
    return pivot.split_column(t(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "#", parts=3)


# -- filters and search -------------------------------------------------------


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice >= 1000")
def filter_range(spark, d):
    return filters.apply(t(spark, d, "part"), filters.in_range("p_size", 10, 20), filters.in_range("p_retailprice", 1000)).select("p_partkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal <> 0 AND c_acctbal > 5000")
def filter_compare(spark, d):
    return filters.apply(t(spark, d, "customer"), filters.compare("c_acctbal", "ne", 0.0), filters.compare("c_acctbal", "gt", 5000.0)).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
def filter_above_avg(spark, d):
    return filters.versus_average(t(spark, d, "customer"), "c_acctbal").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 3 OR l_quantity > 48")
def filter_outside(spark, d):
    return t(spark, d, "lineitem").where(filters.outside("l_quantity", 3, 48)).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer WHERE trim(c_mktsegment) IN ('BUILDING', 'MACHINERY')")
def filter_values(spark, d):
    return t(spark, d, "customer").where(filters.values("c_mktsegment", ["BUILDING", "MACHINERY"])).select("c_custkey")


@query("SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS k FROM events) WHERE k IS NULL")
def filter_blank(spark, d):
    e = t(spark, d, "events").withColumn("k", F.when(F.col("event_id") % 7 != 0, F.col("event_type")))
    return e.where(filters.blank("k")).select("event_id")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'an')")
def filter_contains(spark, d):
    return t(spark, d, "part").where(filters.contains("p_name", "AN")).select("p_partkey")


@query("SELECT n_nationkey FROM nation WHERE lower(n_name) = 'france'")
def filter_exact(spark, d):
    return t(spark, d, "nation").where(filters.exact("n_name", " France ")).select("n_nationkey")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' AND lower(trim(o_orderpriority)) LIKE '%urgent'")
def filter_date_text(spark, d):
    return filters.apply(t(spark, d, "orders"), filters.date_test("o_orderdate", "between", "1996-01-01", "1996-03-31"), filters.text_test("o_orderpriority", "ends", "URGENT")).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT coalesce(l_returnflag IN ('R') AND l_quantity BETWEEN 5 AND 50, false)")
def filter_exclusion(spark, d):
    return t(spark, d, "lineitem").where(filters.exclude(filters.values("l_returnflag", ["R"]) & filters.in_range("l_quantity", 5, 50))).select("l_orderkey", "l_linenumber")


@query("SELECT user_id, event_type FROM events QUALIFY count(*) OVER (PARTITION BY user_id, event_type) > 1")
def filter_duplicates(spark, d):
    return filters.in_duplicate_group(t(spark, d, "events").select("user_id", "event_type"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'machinery'")
def filter_fuzzy(spark, d):
    return filters.fuzzy(t(spark, d, "customer"), "c_mktsegment", "machinry").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'")
def filter_phonetic(spark, d):
    return filters.phonetic(t(spark, d, "customer"), "c_mktsegment", "bilding").select("c_custkey", "c_mktsegment")


@query("""SELECT c_mktsegment AS value, count(*) AS n, CAST(3 AS DOUBLE) AS score FROM customer WHERE lower(c_mktsegment) LIKE 'mach%' GROUP BY 1""")
def suggest_values(spark, d):
    return filters.suggestions(t(spark, d, "customer"), "c_mktsegment", "mach")


def _part_index(spark, d):
    return fuzzy_index.build(t(spark, d, "part"), "p_name", shared_path(spark, "fuzzy-index"))


@query("""WITH w AS (SELECT DISTINCT p_name, unnest(string_split(lower(p_name), ' ')) AS w FROM part), m AS (SELECT p_name, q FROM w, (VALUES ('smal'), ('rng')) v(q)
WHERE starts_with(w, q) OR abs(length(w) - length(q)) <= 2 AND jaro_winkler_similarity(w, q) >= 0.88)
SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM m GROUP BY 1 HAVING count(DISTINCT q) = 2)""")
def fuzzy_indexed(spark, d):
    return fuzzy_index.fuzzy(t(spark, d, "part"), "p_name", _part_index(spark, d), "smal rng").select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name = 'cold widget'")
def phonetic_indexed(spark, d):
    return fuzzy_index.phonetic(t(spark, d, "part"), "p_name", _part_index(spark, d), "kold wijet").select("p_partkey", "p_name")


@query("""WITH v AS (SELECT p_name AS value, count(*) AS n, jaro_similarity(p_name, 'hot bolt') AS j,
CASE WHEN left(p_name, 4) = 'hot ' THEN 4 WHEN left(p_name, 3) = 'hot' THEN 3 WHEN left(p_name, 2) = 'ho' THEN 2 WHEN left(p_name, 1) = 'h' THEN 1 ELSE 0 END AS p FROM part GROUP BY 1),
s AS (SELECT value, n, CASE WHEN value = 'hot bolt' THEN 4 WHEN starts_with(value, 'hot bolt') THEN 3 WHEN contains(value, 'hot bolt') THEN 2 ELSE j + p * 0.1 * (1 - j) END AS score FROM v
WHERE len(list_intersect(list_transform(range(1, length(value)), lambda k: value[k:k+1]), ['ho', 'ot', 't ', ' b', 'bo', 'ol', 'lt'])) > 0)
SELECT value, n, round(score, 6) AS score FROM s WHERE score >= 0.8 ORDER BY s.score DESC, n DESC, value LIMIT 10""")
def suggest_indexed(spark, d):
    return fuzzy_index.suggestions(_part_index(spark, d), "hot bolt").select("value", "n", r("score", 6))


@query("""SELECT 'o_orderstatus' AS facet, o_orderstatus AS label, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderstatus IN ('F') GROUP BY 2""")
def facet_counts(spark, d):
    f = {"o_orderstatus": filters.values("o_orderstatus", ["F"]), "o_orderpriority": filters.text_test("o_orderpriority", "begins", "1")}
    return filters.facets(t(spark, d, "orders"), f, ["o_orderstatus", "o_orderpriority"])


@query("""WITH e AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)
SELECT CAST(greatest(0, least(63, floor((l_extendedprice - lo) / ((hi - lo) / 64)))) AS INTEGER) AS bin, count(*) AS n FROM lineitem, e WHERE l_returnflag = 'R' GROUP BY 1""")
def hist_filtered(spark, d):
    li = t(spark, d, "lineitem")
    return filters.histogram(li.where(filters.values("l_returnflag", ["R"])), "l_extendedprice", base=li)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey DESC LIMIT 10 OFFSET 10")
def page_sorted(spark, d):
    return filters.page(t(spark, d, "customer"), "c_acctbal", "c_custkey", 10, 20, True).select("c_custkey", "c_acctbal")


# -- transforms ---------------------------------------------------------------


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedupe_first(spark, d):
    return transforms.dedupe(t(spark, d, "events").select("event_id", "user_id", "event_type"), "first", "event_id")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedupe_last(spark, d):
    return transforms.dedupe(t(spark, d, "events").select("event_id", "user_id", "event_type"), "last", "event_id")


@query("SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1")
def dedupe_none(spark, d):
    return transforms.dedupe(t(spark, d, "lineitem").select("l_partkey", "l_suppkey"), "none", "_none")


def _holes(spark, d):
    c = t(spark, d, "customer")
    return c.withColumn("bal", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal"))).select("c_custkey", "c_mktsegment", "bal")


_HOLES = "WITH h AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS bal FROM customer) "


@query(_HOLES + "SELECT c_custkey, c_mktsegment, round(coalesce(bal, (SELECT avg(bal) FROM h)), 4) AS bal FROM h")
def impute_mean(spark, d):
    return transforms.impute(_holes(spark, d), "bal", "mean").select("c_custkey", "c_mktsegment", r("bal", 4))


@query(_HOLES + ", m AS (SELECT c_mktsegment AS s, median(bal) AS x FROM h GROUP BY 1) SELECT c_custkey, c_mktsegment, round(coalesce(bal, x), 4) AS bal FROM h JOIN m ON s = c_mktsegment")
def impute_median_group(spark, d):
    return transforms.impute(_holes(spark, d), "bal", "median", by=["c_mktsegment"]).select("c_custkey", "c_mktsegment", r("bal", 4))


@query("""WITH h AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END AS seg FROM customer), m AS (SELECT seg FROM h WHERE seg IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, seg LIMIT 1)
SELECT c_custkey, coalesce(seg, (SELECT seg FROM m)) AS seg FROM h""")
def impute_mode(spark, d):
    h = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("seg"))
    return transforms.impute(h, "seg", "mode")


@query(_HOLES + "SELECT c_custkey, last_value(bal IGNORE NULLS) OVER (ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS bal FROM h")
def impute_ffill(spark, d):
    return transforms.impute(_holes(spark, d).select("c_custkey", "bal"), "bal", "forward", order="c_custkey")


@query(_HOLES + "SELECT c_custkey, first_value(bal IGNORE NULLS) OVER (ORDER BY c_custkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bal FROM h")
def impute_bfill(spark, d):
    return transforms.impute(_holes(spark, d).select("c_custkey", "bal"), "bal", "backward", order="c_custkey")


@query("""WITH f AS (SELECT count(*) AS n, list_sort(list(l_extendedprice)) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, least(greatest(l_extendedprice, v[1 + CAST(floor((n - 1) * 0.05 + 0.5) AS INTEGER)]), v[1 + CAST(floor((n - 1) * 0.95 + 0.5) AS INTEGER)]) AS price FROM lineitem, f""")
def winsorize(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    return transforms.winsorize(li, "price", 5)


@query("SELECT c_custkey, least(greatest(c_acctbal, 0.0), 5000.0) AS c_acctbal FROM customer")
def clip(spark, d):
    return transforms.clip(t(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 0.0, 5000.0)


@query("SELECT c_custkey, floor(c_acctbal / 100 + 0.5) * 100.0 AS c_acctbal FROM customer")
def round_tens(spark, d):
    return transforms.round_column(t(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", -2)


@query("SELECT o_orderkey, make_date(year(o_orderdate), month(o_orderdate), 1) AS date FROM orders")
def combine_date(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    return transforms.combine_date(o, {"year": "y", "month": "m"}).select("o_orderkey", "date")


@query("SELECT o_orderpriority, avg(o_totalprice) IS NOT NULL AS has, round(avg(o_totalprice), 2) AS m FROM orders GROUP BY 1")
def group_mean(spark, d):
    g = transforms.group_simple(t(spark, d, "orders"), "o_orderpriority", "mean", "o_totalprice")
    return g.select("o_orderpriority", F.col("`Mean(o_totalprice)`").isNotNull().alias("has"), F.round("`Mean(o_totalprice)`", 2).alias("m"))


@query("""SELECT c_name AS name, c_acctbal AS bal, 'customer' AS _input_filename FROM customer UNION ALL SELECT s_name, s_acctbal, 'supplier' FROM supplier""")
def append_tables(spark, d):
    a = t(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    b = t(spark, d, "supplier").select(F.col("s_name").alias("Name "), F.col("s_acctbal").alias("BAL"))
    return transforms.append([a, b], ["customer", "supplier"])


@query("""SELECT event_id, CAST(row_number() OVER (ORDER BY user_id, event_id) - 1 AS BIGINT) AS _row_id FROM events""")
def row_numbers(spark, d):
    from .sources.readers import row_ids

    return row_ids(t(spark, d, "events").select("user_id", "event_id"), ["user_id", "event_id"]).select("event_id", "_row_id")


@query("""SELECT event_id, CASE WHEN value > 50 THEN 'Yes' ELSE 'No' END AS high FROM events""")
def flag_rows(spark, d):
    return transforms.flag(t(spark, d, "events").select("event_id", "value"), "high", F.col("value") > 50).select("event_id", "high")


@query()
def knn_impute(spark, d):
    li = t(spark, d, "lineitem").withColumn("l_tax", F.when(F.col("l_orderkey") % 10 != 0, F.col("l_tax")))
    return models.knn_impute(li, "l_tax", ["l_quantity", "l_discount"]).select("l_orderkey", "l_linenumber", "l_tax")


# -- formulas -----------------------------------------------------------------


def _formulas(spark, d, name, keys, made, order=None, by=()):
    df = t(spark, d, name)
    return formula.apply(df, made, order, by=by).select(*keys, *made)


@query("""SELECT o_orderkey, o_totalprice > 100000 AND o_orderstatus = 'F' AS a, CASE WHEN lower(o_orderstatus) = 'f' THEN 'done' ELSE 'open' END AS b,
CASE WHEN o_totalprice < 1000 THEN 'small' WHEN o_totalprice < 100000 THEN 'mid' ELSE 'large' END AS c, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS DOUBLE) AS d, NOT (o_totalprice > 5) AS e FROM orders""")
def formula_logic(spark, d):
    return _formulas(spark, d, "orders", ["o_orderkey"], {
        "a": 'AND([o_totalprice]>100000,[o_orderstatus]="f")', "b": 'IF([o_orderstatus]="F","done","open")',
        "c": 'IFS([o_totalprice]<1000,"small",[o_totalprice]<100000,"mid",TRUE,"large")', "d": 'SWITCH([o_orderstatus],"F",1,"O",2,3)', "e": "NOT([o_totalprice]>5)",
    })


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity - 7 * floor(l_quantity / 7), 6) AS a, round(sqrt(l_extendedprice), 6) AS b, floor(l_extendedprice) AS c, ceil(l_quantity / 5) * 5.0 AS d,
round(pow(l_quantity, 2) + -l_tax, 6) AS e, CAST(NULL AS DOUBLE) AS f, CAST(0 AS DOUBLE) AS g, round((l_quantity + l_tax) / 2, 6) AS h, greatest(l_quantity, 10.0) AS i FROM lineitem""")
def formula_math(spark, d):
    out = _formulas(spark, d, "lineitem", ["l_orderkey", "l_linenumber"], {
        "a": "MOD([l_quantity],7)", "b": "SQRT([l_extendedprice])", "c": "INT([l_extendedprice])", "d": "CEILING([l_quantity],5)", "e": "[l_quantity]^2+-[l_tax]",
        "f": "[l_quantity]/0", "g": "IFERROR([l_quantity]/0,0)", "h": "AVERAGE([l_quantity],[l_tax])", "i": "MAX([l_quantity],10)",
    })
    return out.select("l_orderkey", "l_linenumber", r("a", 6), r("b", 6), "c", "d", r("e", 6), "f", "g", r("h", 6), "i")


@query("""SELECT p_partkey, upper(left(p_brand, 3)) AS a, CAST(length(p_name) AS DOUBLE) AS b, p_brand || '-' || p_partkey AS c, contains(lower(p_type), 'steel') AS d, replace(p_type, ' ', '_') AS e,
split_part(p_brand, '#', 1) AS f, substr(p_brand, strpos(p_brand, '#') + 1) AS g, CAST(strpos(p_brand, '#') AS DOUBLE) AS h, right(p_brand, 2) AS i, substr(p_type, 3, 4) AS j FROM part""")
def formula_text(spark, d):
    return _formulas(spark, d, "part", ["p_partkey"], {
        "a": "UPPER(LEFT([p_brand],3))", "b": "LEN([p_name])", "c": '[p_brand]&"-"&[p_partkey]', "d": 'CONTAINS([p_type],"STEEL")', "e": 'SUBSTITUTE([p_type]," ","_")',
        "f": 'TEXTBEFORE([p_brand],"#")', "g": 'TEXTAFTER([p_brand],"#")', "h": 'FIND("#",[p_brand])', "i": "RIGHT([p_brand],2)", "j": "MID([p_type],3,4)",
    })


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS a, CAST(isodow(o_orderdate) AS DOUBLE) AS b, CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS c,
CAST(last_day(CAST(o_orderdate AS DATE)) AS DATE) AS d, CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS e, CAST(week(o_orderdate) AS DOUBLE) AS f, make_date(year(o_orderdate), 1, 1) AS g, CAST(datediff('day', CAST(o_orderdate AS DATE), DATE '2024-01-01') AS DOUBLE) AS h FROM orders""")
def formula_date(spark, d):
    return _formulas(spark, d, "orders", ["o_orderkey"], {
        "a": "YEAR([o_orderdate])", "b": "WEEKDAY([o_orderdate],2)", "c": 'DAYS([o_orderdate],DATE(1995,1,1))', "d": "EOMONTH([o_orderdate],0)", "e": "[o_orderdate]+30",
        "f": "WEEKNUM([o_orderdate],21)", "g": "DATE(YEAR([o_orderdate]),1,1)", "h": 'DATEDIF([o_orderdate],TODAY(),"d")',
    })


@query("""SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_suppkey) AS DOUBLE) AS a, CAST(rank() OVER (ORDER BY s_acctbal DESC) AS DOUBLE) AS b, round(100 * s_acctbal / sum(s_acctbal) OVER (), 6) AS c,
round(sum(s_acctbal) OVER (ORDER BY s_suppkey), 2) AS d, lag(s_acctbal) OVER (ORDER BY s_suppkey) AS e, round(avg(s_acctbal) OVER (), 4) AS f, round(median(s_acctbal) OVER (), 4) AS g, round(stddev_samp(s_acctbal) OVER (), 4) AS h,
greatest(1.0, ceil((s_acctbal - min(s_acctbal) OVER ()) / ((max(s_acctbal) OVER () - min(s_acctbal) OVER ()) / 5))) AS i FROM supplier""")
def formula_window(spark, d):
    out = _formulas(spark, d, "supplier", ["s_suppkey"], {
        "a": "ROWNUMBER()", "b": "RANK([s_acctbal])", "c": "PERCENTOFTOTAL([s_acctbal])", "d": "RUNNINGSUM([s_acctbal])", "e": "PREVIOUS([s_acctbal])",
        "f": "COLUMNMEAN([s_acctbal])", "g": "COLUMNMEDIAN([s_acctbal])", "h": "COLUMNSTDEV([s_acctbal])", "i": "BIN([s_acctbal],5)",
    }, "s_suppkey")
    return out.select("s_suppkey", "a", "b", r("c", 6), r("d"), "e", r("f", 4), r("g", 4), r("h", 4), "i")


# -- cleans -------------------------------------------------------------------


@query("""SELECT c_custkey, upper(c_name) AS a, left(c_name, 2) || repeat('*', length(c_name) - 4) || right(c_name, 2) AS b, substr(sha256('s' || chr(0) || trim(c_name)), 1, 16) AS c,
CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE c_mktsegment END AS d, regexp_extract(c_name, '[0-9]+') AS e, replace(c_name, 'Customer', 'Client') AS f FROM customer""")
def clean_text(spark, d):
    n = F.col("c_name")
    return t(spark, d, "customer").select(
        "c_custkey", cleans.case(n, "upper").alias("a"), cleans.mask(n, 2, 2).alias("b"), cleans.hashed(n, "s").alias("c"),
        cleans.recode(F.col("c_mktsegment"), {"BUILDING": "B"}).alias("d"), F.regexp_extract(n, "[0-9]+", 0).alias("e"), cleans.replace(n, "Customer", "Client").alias("f"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_quantity AS a, -l_quantity AS b, CAST(l_shipdate AS DATE) AS c FROM lineitem""")
def clean_numbers(spark, d):
    li = t(spark, d, "lineitem")
    q = F.format_number("l_quantity", 2)
    return li.select(
        "l_orderkey", "l_linenumber", cleans.number(F.concat(F.lit("$ "), q)).alias("a"), cleans.number(F.concat(F.lit("("), q, F.lit(")"))).alias("b"),
        cleans.to_date(F.date_format("l_shipdate", "dd/MM/yyyy")).alias("c"),
    )


# -- compare ------------------------------------------------------------------


def _versions(spark, d):
    a = t(spark, d, "orders")
    b = a.where("o_orderkey % 100 <> 1").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 50 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    extra = a.where("o_orderkey % 100 = 2").withColumn("o_orderkey", F.col("o_orderkey") + 100000000)
    return a, b.unionByName(extra)


_VERSIONS = """WITH a AS (SELECT * FROM orders), b AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 100 <> 1
UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 100 = 2) """


@query(_VERSIONS + """SELECT CASE WHEN b.o_orderkey IS NULL THEN 'only A' WHEN a.o_orderkey IS NULL THEN 'only B' WHEN a.o_totalprice <> b.o_totalprice THEN 'changed' ELSE 'identical' END AS status, count(*) AS n
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey GROUP BY 1""")
def compare_key(spark, d):
    a, b = _versions(spark, d)
    order = lambda df: df.withColumn("_row_id", F.col("o_orderkey"))
    return compare.summary(compare.match(order(a), order(b), ["o_orderkey"], "_row_id"))


@query(_VERSIONS + """SELECT a.o_orderkey, 'o_totalprice' AS "column", a.o_totalprice AS old, b.o_totalprice AS new FROM a JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_totalprice <> b.o_totalprice""")
def compare_changes(spark, d):
    a, b = _versions(spark, d)
    order = lambda df: df.withColumn("_row_id", F.col("o_orderkey"))
    out = compare.changes_long(compare.match(order(a), order(b), ["o_orderkey"], "_row_id"), ["o_orderkey"])
    return out.withColumn("old", F.col("old").cast("double")).withColumn("new", F.col("new").cast("double"))


@query(_VERSIONS + """, x AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM a GROUP BY 1, 2), y AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM b GROUP BY 1, 2)
SELECT CAST(sum(least(coalesce(x.n, 0), coalesce(y.n, 0))) AS BIGINT) AS both, CAST(sum(greatest(coalesce(x.n, 0) - coalesce(y.n, 0), 0)) AS BIGINT) AS only_a, CAST(sum(greatest(coalesce(y.n, 0) - coalesce(x.n, 0), 0)) AS BIGINT) AS only_b
FROM x FULL JOIN y ON x.o_custkey = y.o_custkey AND x.o_orderstatus = y.o_orderstatus""")
def compare_content(spark, d):
    return compare.content_match(*_versions(spark, d), ["o_custkey", "o_orderstatus"])


@query("""SELECT count(*) AS n, count(*) FILTER (a.s_name = b.c_name) AS same FROM supplier a FULL JOIN (SELECT * FROM customer) b ON a.s_suppkey = b.c_custkey""")
def compare_position(spark, d):
    a = t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    b = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return compare.position_match(a, b, "k", ["name"]).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a_name") == F.col("b_name")).alias("same"))


@query(_VERSIONS + """SELECT count(*) AS n, round(sum(b.o_totalprice - a.o_totalprice), 2) AS total, round(max(abs(b.o_totalprice - a.o_totalprice)), 2) AS largest FROM a JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_totalprice <> b.o_totalprice""")
def compare_diffs(spark, d):
    a, b = _versions(spark, d)
    order = lambda df: df.withColumn("_row_id", F.col("o_orderkey"))
    m = compare.value_diffs(compare.match(order(a), order(b), ["o_orderkey"], "_row_id").where("status = 'changed'"), "o_totalprice")
    return m.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("diff"), 2).alias("total"), F.round(F.max(F.abs("diff")), 2).alias("largest"))


_PSI = """WITH e AS (SELECT quantile_cont(l_quantity, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS e FROM lineitem WHERE l_returnflag = 'R'),
p AS (SELECT len(list_filter(e, lambda z: z <= l_quantity)) AS bin, count(*) AS n FROM lineitem, e WHERE l_returnflag = 'R' GROUP BY 1),
q AS (SELECT len(list_filter(e, lambda z: z <= l_quantity)) AS bin, count(*) AS n FROM lineitem, e WHERE l_returnflag = 'N' GROUP BY 1),
s AS (SELECT greatest(coalesce(p.n / (SELECT sum(n) FROM p), 0), 1e-4) AS a, greatest(coalesce(q.n / (SELECT sum(n) FROM q), 0), 1e-4) AS b FROM range(10) r(bin) LEFT JOIN p ON p.bin = r.bin LEFT JOIN q ON q.bin = r.bin)
SELECT 'l_quantity' AS "column", round(sum((b - a) * ln(b / a)), 6) AS psi FROM s"""


@query(_PSI)
def compare_shift(spark, d):
    li = t(spark, d, "lineitem")
    return compare.psi(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'N'"), "l_quantity").select("column", r("psi", 6))


@query("""WITH a AS (SELECT o_orderpriority AS g, avg(o_totalprice) AS m, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderpriority AS g, avg(o_totalprice) AS m, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT a.g AS "group", round(a.m, 2) AS mean_a, round(b.m, 2) AS mean_b, a.n AS n_a, b.n AS n_b FROM a FULL JOIN b ON a.g = b.g""")
def compare_groups(spark, d):
    o = t(spark, d, "orders")
    out = compare.group_shift(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_orderpriority", "o_totalprice")
    return out.select("group", r("mean_a"), r("mean_b"), "n_a", "n_b")


@query("""WITH c AS (SELECT o_orderpriority AS l, count(*) FILTER (o_orderstatus = 'F') AS na, count(*) FILTER (o_orderstatus = 'O') AS nb FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1), s AS (SELECT sum(na) AS ta, sum(nb) AS tb FROM c)
SELECT 'o_orderpriority' AS "column", round(sqrt(sum(pow(na - (na + nb) * ta / (ta + tb), 2) / ((na + nb) * ta / (ta + tb)) + pow(nb - (na + nb) * tb / (ta + tb), 2) / ((na + nb) * tb / (ta + tb))) / max(ta + tb)), 6) AS v FROM c, s""")
def compare_category_shift(spark, d):
    o = t(spark, d, "orders")
    return compare.category_shift(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_orderpriority").select("column", r("v", 6))


@query("""SELECT 'o_orderkey' AS "column", count(DISTINCT o_orderkey) AS kinds, count(DISTINCT o_orderkey) AS shared FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), count(DISTINCT o_custkey) FROM orders""")
def compare_suggest_keys(spark, d):
    o = t(spark, d, "orders")
    return compare.suggest_keys(o, o, ["o_orderkey", "o_custkey"]).select("column", "kinds", "shared")


@query()
def compare_fuzzy(spark, d):
    a = t(spark, d, "supplier").select("s_suppkey", "s_name")
    b = a.select((F.col("s_suppkey") + 1000).alias("k"), F.concat(F.lit("The "), F.regexp_replace("s_name", "Supplier", "Suplier"), F.lit(" Ltd")).alias("s_name"))
    return compare.fuzzy_match(a, b, "s_name", "s_suppkey", "k")


# -- profiles and data quality ------------------------------------------------


@query("""SELECT 'c_acctbal' AS "column", count(*) AS rows, count(*) - count(c_acctbal) AS nulls, count(DISTINCT c_acctbal) AS "distinct", min(c_acctbal) AS min, max(c_acctbal) AS max, round(avg(c_acctbal), 4) AS mean, round(stddev_pop(c_acctbal), 4) AS sd FROM customer
UNION ALL SELECT 'c_mktsegment', count(*), count(*) - count(c_mktsegment), count(DISTINCT c_mktsegment), NULL, NULL, NULL, NULL FROM customer""")
def dq_column_stats(spark, d):
    return profile.column_stats(t(spark, d, "customer"), ["c_acctbal", "c_mktsegment"]).select("column", "rows", "nulls", "distinct", "min", "max", r("mean", 4), r("sd", 4))


_FLAWED = """WITH v AS (SELECT c_custkey AS k, CASE WHEN k % 10 = 0 THEN lower(c_mktsegment) WHEN k % 17 = 0 THEN 'N/A' WHEN k % 13 = 0 THEN NULL ELSE c_mktsegment END AS segment,
CASE WHEN k % 9 = 0 THEN '$' || k WHEN k % 8 = 0 THEN 'oops' ELSE k || '.5' END AS amount, CASE WHEN k % 20 = 0 THEN 'AB' || k ELSE 'AB-' || k END AS code, CASE WHEN k % 7 = 0 THEN '25/12/2023' ELSE '2023-12-25' END AS day, CASE WHEN k % 50 = 0 THEN 240 ELSE k % 90 END AS age FROM customer),
g AS (SELECT *, k % 10 <> 0 AND k % 17 = 0 AS holder, segment IS NULL AS blank, k % 10 = 0 AS variant, k % 9 <> 0 AND k % 8 = 0 AS oops, k % 20 = 0 AS off, k % 7 = 0 AS minor, k % 9 = 0 AS symbol, k % 50 = 0 AS old FROM v)
"""


def _flawed(spark, d):
    """Customers with planted flaws: a minority spelling, placeholders, blanks, numbers and dates written two ways, impossible ages."""
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    return t(spark, d, "customer").select(
        k.alias("k"),
        F.when(k % 10 == 0, F.lower(s)).when(k % 17 == 0, "N/A").when(k % 13 == 0, None).otherwise(s).alias("segment"),
        F.when(k % 9 == 0, F.concat(F.lit("$"), k.cast("string"))).when(k % 8 == 0, "oops").otherwise(F.concat(k.cast("string"), F.lit(".5"))).alias("amount"),
        F.concat(F.when(k % 20 == 0, "AB").otherwise("AB-"), k.cast("string")).alias("code"),
        F.when(k % 7 == 0, "25/12/2023").otherwise("2023-12-25").alias("day"),
        F.when(k % 50 == 0, 240).otherwise(k % 90).alias("age"),
    )


@query(_FLAWED + """, c AS (SELECT count(*) AS n, count(*) FILTER (holder OR blank) AS nulls, count(*) FILTER (oops) AS oops, count(*) FILTER (off) AS off, count(*) FILTER (minor) AS minor, count(*) FILTER (symbol) AS symbol, count(*) FILTER (old) AS old, count(*) FILTER (variant) AS variant FROM g),
r AS (SELECT 100 * (6 * n - nulls) / (6 * n) AS completeness, 100 * (1 - (oops + off + minor + symbol + old) / (6 * n - nulls + n + n - oops + n)) AS validity, 100 * (1 - variant / (n - nulls)) AS consistency FROM c)
SELECT round((30 * completeness + 30 * validity + 15 * 100 + 15 * consistency) / 90, 6) AS score, round(completeness, 6) AS completeness, round(validity, 6) AS validity, 100.0 AS uniqueness, round(consistency, 6) AS consistency FROM r""")
def dq_scorecard(spark, d):
    return scorecard.score(_flawed(spark, d)).select(r("score", 6), r("completeness", 6), r("validity", 6), "uniqueness", r("consistency", 6))


@query(_FLAWED + """, n AS (SELECT count(*) AS n, count(*) FILTER (holder) AS holder, count(*) FILTER (variant) AS variant, count(*) FILTER (symbol) AS symbol, count(*) FILTER (oops) AS oops, count(*) FILTER (off) AS off, count(*) FILTER (minor) AS minor, count(*) FILTER (old) AS old FROM g)
SELECT 'blank placeholders' AS kind, 'segment' AS "column", holder AS rows, false AS blocked FROM n UNION ALL SELECT 'merge spellings', 'segment', variant, false FROM n UNION ALL SELECT 'convert to number', 'amount', n, oops > 0.1 * n FROM n UNION ALL SELECT 'strip signs', 'amount', symbol, false FROM n
UNION ALL SELECT 'review format', 'code', off, false FROM n UNION ALL SELECT 'convert to date', 'day', n, false FROM n UNION ALL SELECT 'one date format', 'day', minor, false FROM n UNION ALL SELECT 'review values', 'age', old, false FROM n""")
def dq_suggestions(spark, d):
    return scorecard.suggestions(_flawed(spark, d), ["segment", "amount", "code", "day", "age"])


@query(_FLAWED + """SELECT count(*) FILTER (holder OR variant OR oops OR off OR minor OR symbol) AS affected, count(*) AS rows FROM g""")
def dq_findings_rows(spark, d):
    df = _flawed(spark, d)
    return scorecard.rows_affected(df, scorecard.find(df))


@query(_FLAWED + """SELECT k AS row, 'segment' AS "column", CASE WHEN holder THEN 'placeholder' WHEN blank THEN 'completeness' ELSE 'consistency.variants' END AS "check", coalesce(segment, '') AS value FROM g WHERE holder OR blank OR variant
UNION ALL SELECT k, 'amount', CASE WHEN oops THEN 'validity' ELSE 'validity.symbols' END, amount FROM g WHERE oops OR symbol
UNION ALL SELECT k, 'code', 'validity.pattern', code FROM g WHERE off UNION ALL SELECT k, 'day', 'validity.dateformat', day FROM g WHERE minor UNION ALL SELECT k, 'age', 'validity.range', CAST(age AS VARCHAR) FROM g WHERE old""")
def dq_findings_cells(spark, d):
    df = _flawed(spark, d)
    return scorecard.exceptions(df, scorecard.find(df), "k").select("row", "column", "check", "value")


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def dq_top_values(spark, d):
    return profile.top_values(t(spark, d, "customer"), "c_mktsegment", 3)


@query("""WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) FILTER (n > 1) AS groups, CAST(sum(n) FILTER (n > 1) AS BIGINT) AS rows_in_groups, CAST(0 AS BIGINT) AS empty_rows, CAST(0 AS BIGINT) AS null_rows, CAST(0 AS BIGINT) AS null_cells FROM g""")
def dq_duplicates(spark, d):
    return profile.dataset_stats(t(spark, d, "events").select("user_id", "event_type"))


@query("""WITH g AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING n > 1) SELECT count(*) AS groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS beyond_first, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM g""")
def dq_key_duplicates(spark, d):
    return profile.key_duplicates(t(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query("""WITH m AS (SELECT median(c_acctbal) AS m FROM customer), s AS (SELECT median(abs(c_acctbal - m)) AS mad FROM customer, m)
SELECT 'c_acctbal' AS "column", round(m - 3.5 / 0.6745 * mad, 4) AS low, round(m + 3.5 / 0.6745 * mad, 4) AS high FROM m, s""")
def dq_fence_mad(spark, d):
    return profile.value_fence(t(spark, d, "customer"), "c_acctbal").select("column", r("low", 4), r("high", 4))


@query("""WITH v AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 100000 + value ELSE value END AS x FROM events), m AS (SELECT count(x) AS n, min(x) AS lo, quantile_cont(x, [0.005, 0.25, 0.5, 0.75, 0.995]) AS q FROM v),
k AS (SELECT *, lo >= 0 AND coalesce((q[4] + q[2] - 2 * q[3]) / nullif(q[4] - q[2], 0), 0) > 0.1 AS lg FROM m),
y AS (SELECT event_id, x, CASE WHEN lg THEN ln(1 + greatest(x, 0)) ELSE x END AS y, CASE WHEN lg THEN ln(1 + greatest(q[3], 0)) ELSE q[3] END AS mid, lg, n, q FROM v, k WHERE x IS NOT NULL),
s AS (SELECT median(abs(y - mid)) AS mad FROM y), f AS (SELECT event_id, x, n, q, mad, lg, CASE WHEN lg THEN exp(mid - 3.5 / 0.6745 * mad) - 1 ELSE mid - 3.5 / 0.6745 * mad END AS a, CASE WHEN lg THEN exp(mid + 3.5 / 0.6745 * mad) - 1 ELSE mid + 3.5 / 0.6745 * mad END AS b FROM y, s),
w AS (SELECT *, count(*) FILTER (x < a OR x > b) OVER () AS bad FROM f)
SELECT event_id, round(x, 4) AS x FROM w WHERE n >= 20 AND mad > 0 AND CASE WHEN n >= 500 AND bad > 0.02 * n THEN x < q[1] OR x > q[5] ELSE x < a OR x > b END""")
def dq_value_anomalies(spark, d):
    e = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 97 == 0, 100000 + F.col("value")).otherwise(F.col("value")).alias("x"))
    return profile.value_anomalies(e, "x").select("event_id", r("x", 4))


@query("""WITH f AS (SELECT quantile_cont(length(text), 0.9) AS p, count(*) AS k FROM documents) SELECT doc_id FROM documents, f WHERE k >= 8 AND length(text) > 3 * p""")
def dq_length_fence(spark, d):
    return profile.length_fence(t(spark, d, "documents"), "text").select("doc_id")


@query("""WITH m AS (SELECT o_orderpriority AS g, median(o_totalprice) AS m, count(*) AS n FROM orders GROUP BY 1 HAVING n >= 30), s AS (SELECT o_orderpriority AS g, median(abs(o_totalprice - m)) AS mad FROM orders JOIN m ON g = o_orderpriority GROUP BY 1 HAVING mad > 0)
SELECT o_orderkey, round(0.6745 * (o_totalprice - m) / mad, 4) AS z FROM orders JOIN m ON m.g = o_orderpriority JOIN s ON s.g = o_orderpriority WHERE abs(0.6745 * (o_totalprice - m) / mad) > 1.2""")
def dq_group_anomaly(spark, d):
    return profile.group_anomalies(t(spark, d, "orders"), "o_totalprice", "o_orderpriority", limit=1.2).select("o_orderkey", r("z", 4))


@query("""WITH f AS (SELECT c_nationkey AS g, arg_min(c_mktsegment, c_custkey) AS v FROM customer GROUP BY 1) SELECT count(*) AS rows, count(*) FILTER (c_mktsegment <> v) AS violations FROM customer JOIN f ON g = c_nationkey""")
def dq_dependency(spark, d):
    return profile.dependency(t(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_custkey").select("rows", "violations")


@query("""WITH m AS (SELECT regexp_replace(regexp_replace(c_name, '[A-Za-z]+', 'A', 'g'), '[0-9]+', '9', 'g') AS mask, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT sum(n) AS c FROM m)
SELECT mask, n, round(n / c, 6) AS share FROM m, s ORDER BY n DESC, mask LIMIT 1""")
def dq_mask(spark, d):
    return profile.dominant_mask(t(spark, d, "customer"), "c_name").select("mask", "n", r("share", 6))


@query("""SELECT 'r0' AS rule, count(*) AS rows, count(*) FILTER (l_quantity IS NULL) AS failures FROM lineitem UNION ALL SELECT 'r1', count(*), count(*) FILTER (l_quantity < 2 OR l_quantity > 45) FROM lineitem
UNION ALL SELECT 'r2', count(*), count(*) FILTER (l_returnflag NOT IN ('R', 'N')) FROM lineitem UNION ALL SELECT 'r3', count(*), count(*) FILTER (NOT l_extendedprice >= l_quantity) FROM lineitem
UNION ALL SELECT 'r4', (SELECT count(*) FROM lineitem), CAST(coalesce(sum(n - 1) FILTER (n > 1), 0) AS BIGINT) FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)""")
def dq_rules(spark, d):
    rules = [Rule("notNull", "l_quantity"), Rule("range", "l_quantity", 2, 45), Rule("inList", "l_returnflag", values=("R", "N")), Rule("compare", "l_extendedprice", other="l_quantity"), Rule("unique", "l_orderkey")]
    return profile.check_rules(t(spark, d, "lineitem"), rules).select("rule", "rows", "failures")


@query("""SELECT c_custkey AS row, 'r0' AS rule, 'c_acctbal' AS "column", c_acctbal AS value FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000""")
def dq_exceptions(spark, d):
    out = profile.exceptions(t(spark, d, "customer"), [Rule("range", "c_acctbal", 0, 9000)], "c_custkey")
    return out.withColumn("value", F.col("value").cast("double"))


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (c_acctbal < 0) AS bad, count(DISTINCT (c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment)) AS u FROM customer)
SELECT round((30 * 1.0 + 15 * (1 - (n - u) / n) + 30 * (1 - bad / n)) / 75 * 100, 4) AS score FROM c""")
def dq_score(spark, d):
    return profile.score(t(spark, d, "customer"), [Rule("range", "c_acctbal", 0)]).select(r("score", 4))


@query("""SELECT p_type AS word, count(*) AS n FROM (SELECT unnest(string_split(lower(p_type), ' ')) AS p_type FROM part) WHERE length(p_type) >= 2 GROUP BY 1 ORDER BY n DESC, word LIMIT 5""")
def text_profile(spark, d):
    return profile.text_profile(t(spark, d, "part"), "p_type", 5)


@query("""SELECT CASE WHEN regexp_matches(trim(k), '^[+-]?[0-9]+([.,][0-9]+)*%?$') AND length(k) < 8 THEN 'number' ELSE 'other' END AS shape, count(*) AS n FROM (SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer) GROUP BY 1""")
def pii_shapes(spark, d):
    s = profile.shapes(t(spark, d, "customer").withColumn("k", F.col("c_custkey").cast("string")), "k")
    return s.groupBy(F.when(F.col("shape") == "number", "number").otherwise("other").alias("shape")).agg(F.sum("n").alias("n"))


@query()
def similar_values(spark, d):
    return profile.similar_clusters(t(spark, d, "part"), "p_name")


@query("""SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem""")
def corr_matrix(spark, d):
    return profile.correlation_matrix(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]).select("a", "b", r("r", 6))


@query("""WITH q AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem)
SELECT round(corr(a, b), 6) AS rho FROM q""")
def rel_spearman(spark, d):
    return profile.spearman(t(spark, d, "lineitem"), "l_quantity", "l_discount").select(r("rho", 6))


@query("""WITH o AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY 1, 2), x AS (SELECT a, sum(o) AS r FROM o GROUP BY 1), y AS (SELECT b, sum(o) AS c FROM o GROUP BY 1)
SELECT round(sqrt((sum(o.o * o.o / (x.r * y.c)) - 1) / (least(count(DISTINCT o.a), count(DISTINCT o.b)) - 1)), 6) AS v FROM o JOIN x ON x.a = o.a JOIN y ON y.b = o.b""")
def rel_cramers(spark, d):
    return profile.cramers_v(t(spark, d, "orders"), "o_orderstatus", "o_orderpriority").select(r("v", 6))


@query("""WITH g AS (SELECT o_orderpriority AS k, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1), w AS (SELECT avg(o_totalprice) AS mm, var_pop(o_totalprice) AS v, count(*) AS nn FROM orders)
SELECT round(sum(n * pow(m - mm, 2)) / max(v * nn), 8) AS eta2 FROM g, w""")
def rel_eta2(spark, d):
    return profile.eta_squared(t(spark, d, "orders"), "o_orderpriority", "o_totalprice").select(r("eta2", 8))


@query("""SELECT 'a' AS a, 'b' AS b, count(*) FILTER (event_id % 2 = 0 AND event_id % 3 = 0) AS n FROM events""")
def comissing(spark, d):
    e = t(spark, d, "events").select(F.when(F.col("event_id") % 2 != 0, 1).alias("a"), F.when(F.col("event_id") % 3 != 0, 1).alias("b"))
    return profile.co_missing(e, ["a", "b"])


@query("""SELECT CAST(floor(event_id / 100) AS BIGINT) AS block, count(*) FILTER (event_id % 7 = 0) AS value FROM events GROUP BY 1""")
def missing_blocks(spark, d):
    e = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    return profile.missing_map(e, ["value"], "event_id")


@query("""SELECT count(*) FILTER (l_extendedprice >= l_quantity) AS passed, count(*) FILTER (l_extendedprice < l_quantity) AS failed, CAST(0 AS BIGINT) AS not_judged FROM lineitem""")
def pair_check(spark, d):
    return profile.pair_check(t(spark, d, "lineitem"), "l_extendedprice", "l_quantity", "gte")


@query("""WITH m AS (SELECT median(o_orderkey) AS m FROM orders), a AS (SELECT o_totalprice AS x FROM orders, m WHERE o_orderkey <= m), b AS (SELECT o_totalprice AS x FROM orders, m WHERE o_orderkey > m),
e AS (SELECT quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM a),
p AS (SELECT len(list_filter(e, lambda v: v <= x)) AS bin, count(*) AS n FROM a, e GROUP BY 1), q AS (SELECT len(list_filter(e, lambda v: v <= x)) AS bin, count(*) AS n FROM b, e GROUP BY 1),
s AS (SELECT greatest(coalesce(p.n, 0) / (SELECT count(*) FROM a), 0.0001) AS p, greatest(coalesce(q.n, 0) / (SELECT count(*) FROM b), 0.0001) AS q FROM (SELECT unnest(range(10)) AS bin) i LEFT JOIN p ON p.bin = i.bin LEFT JOIN q ON q.bin = i.bin),
t AS (SELECT sum((q - p) * ln(q / p)) AS psi FROM s)
SELECT 'o_totalprice' AS "column", round(psi, 8) AS psi, round(((SELECT avg(x) FROM b) - (SELECT avg(x) FROM a)) / sqrt(((SELECT var_samp(x) FROM a) + (SELECT var_samp(x) FROM b)) / 2), 8) AS smd, CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.25 THEN 'mild' ELSE 'large' END AS shift FROM t""")
def drift_psi(spark, d):
    a, b = profile.drift_halves(t(spark, d, "orders"), "o_totalprice", "o_orderkey")
    return compare.psi(a, b, "o_totalprice").select("column", r("psi", 8), r("smd", 8), "shift")


@query("""SELECT lower(p_type) AS key, CAST(2 AS BIGINT) AS spellings, count(*) AS rows FROM part GROUP BY 1""")
def spelling_variants(spark, d):
    p = t(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.lower("p_type")).otherwise(F.col("p_type")).alias("v"))
    return profile.variants(p, "v").select("key", "spellings", "rows")


@query()
def outliers_isolation_forest(spark, d):
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    out = models.isolation_forest(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *columns), columns).drop(*columns)
    return models.flag_top(out).where("outlier").select("l_orderkey", "l_linenumber", "outlier_score")


@query()
def outliers_pca(spark, d):
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    out = models.pca_residual(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *columns), columns, 2).drop(*columns)
    return models.flag_top(out).where("outlier").select("l_orderkey", "l_linenumber", "outlier_score")


@query("""WITH m AS (SELECT median(c_acctbal) AS a, median(c_nationkey) AS b FROM customer), s AS (SELECT a, b, 1.4826 * (SELECT median(abs(c_acctbal - a)) FROM customer, m) AS sa, 1.4826 * (SELECT median(abs(c_nationkey - b)) FROM customer, m) AS sb FROM m),
z AS (SELECT c_custkey AS id, (c_acctbal - a) / sa AS x, (c_nationkey - b) / sb AS y FROM customer, s), p AS (SELECT u.id, v.id AS o, sqrt((u.x - v.x) * (u.x - v.x) + (u.y - v.y) * (u.y - v.y)) AS d FROM z u JOIN z v ON u.id <> v.id),
k AS (SELECT id, d AS kth FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY d) = 20), n AS (SELECT p.id, o, d FROM p JOIN k ON k.id = p.id WHERE d <= kth),
l AS (SELECT n.id, count(*) / sum(greatest(d, kth)) AS lrd FROM n JOIN k ON k.id = n.o GROUP BY 1), f AS (SELECT n.id, avg(q.lrd) / any_value(l.lrd) AS score FROM n JOIN l q ON q.id = n.o JOIN l ON l.id = n.id GROUP BY 1)
SELECT id AS c_custkey, round(score, 6) AS outlier_score FROM f WHERE score > (SELECT quantile_cont(score, 0.99) FROM f)""")
def outliers_lof(spark, d):
    out = neighbours.local_outlier_factor(t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"])
    return models.flag_top(out).where("outlier").select("c_custkey", r("outlier_score", 6))


# -- reviews ------------------------------------------------------------------


@query("""SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'iso' WHEN o_orderkey % 3 = 1 AND day(o_orderdate) > 12 THEN 'day first' WHEN o_orderkey % 3 = 1 THEN 'ambiguous' ELSE 'compact' END AS layout, count(*) AS n FROM orders GROUP BY 1""")
def review_date_layouts(spark, d):
    k, at = F.col("o_orderkey") % 3, F.col("o_orderdate")
    o = t(spark, d, "orders").select(F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "dd/MM/yyyy")).otherwise(F.date_format(at, "yyyyMMdd")).alias("x"))
    return review.date_layouts(o, "x")


@query("""SELECT count(*) FILTER (day(o_orderdate) > 12) AS day_first, CAST(0 AS BIGINT) AS month_first, count(*) FILTER (day(o_orderdate) <= 12) AS ambiguous, false AS conflict FROM orders""")
def review_date_conflict(spark, d):
    return review.date_order_conflict(t(spark, d, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("x")), "x")


@query("""SELECT CASE WHEN l_linenumber % 2 = 0 THEN '$' ELSE 'none' END AS symbol, count(*) AS n FROM lineitem GROUP BY 1""")
def review_number_symbols(spark, d):
    return review.number_symbols(t(spark, d, "lineitem").select(F.concat(F.when(F.col("l_linenumber") % 2 == 0, "$").otherwise(""), F.format_number("l_quantity", 2)).alias("x")), "x")


@query("""SELECT CAST(-999 AS DOUBLE) AS value, count(*) AS n FROM lineitem WHERE l_orderkey % 20 = 0""")
def review_sentinels(spark, d):
    return review.sentinels(t(spark, d, "lineitem").withColumn("x", F.when(F.col("l_orderkey") % 20 == 0, -999.0).otherwise(F.col("l_quantity"))), "x")


@query("""SELECT 'age' AS "column", CAST(0 AS DOUBLE) AS low, CAST(120 AS DOUBLE) AS high, count(*) FILTER (c_acctbal < 0 OR c_acctbal > 120) AS outside FROM customer""")
def review_plausibility(spark, d):
    return review.plausibility(t(spark, d, "customer").select(F.col("c_acctbal").alias("age"), "c_name"), ["age", "c_name"])


@query("""SELECT round(avg((l_discount BETWEEN 0 AND 1)::INT), 6) AS shares, round(avg((l_discount > 1 AND l_discount <= 100)::INT), 6) AS percents, false AS mixed FROM lineitem""")
def review_scale_mix(spark, d):
    return review.scale_mix(t(spark, d, "lineitem"), "l_discount").select(r("shares", 6), r("percents", 6), "mixed")


@query("""SELECT 'c_acctbal' AS "column", round(avg((c_custkey % 5 <> 0)::INT), 6) AS before, CAST(1 AS DOUBLE) AS after, true AS moved FROM customer""")
def review_history(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_acctbal")
    return review.history(c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal"))), c, ["c_acctbal"]).select("column", r("before", 6), "after", "moved")


@query()
def review_reference(spark, d):
    names = F.element_at(F.array(*[F.lit(x) for x in ("Monday", "Tusday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")]), (F.col("event_id") % 7 + 1).cast("int"))
    return review.reference_accuracy(t(spark, d, "events").select(names.alias("x")), "x")


@query("""WITH e AS (SELECT l_quantity, l_extendedprice, l_quantity * 1000 + l_extendedprice AS mix, CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END AS lot, l_returnflag FROM lineitem),
p AS (SELECT 'l_quantity' AS a, 'mix' AS b, 'pearson' AS kind, corr(l_quantity, mix) AS x FROM e UNION ALL SELECT 'l_extendedprice', 'mix', 'pearson', corr(l_extendedprice, mix) FROM e UNION ALL SELECT 'l_quantity', 'l_extendedprice', 'pearson', corr(l_quantity, l_extendedprice) FROM e),
o AS (SELECT lot, l_returnflag, count(*) AS o FROM e GROUP BY 1, 2), v AS (SELECT 'lot' AS a, 'l_returnflag' AS b, 'cramer' AS kind, sqrt(greatest(0, sum(o * o / ((SELECT sum(o) FROM o x WHERE x.lot = o.lot) * (SELECT sum(o) FROM o y WHERE y.l_returnflag = o.l_returnflag))) - 1) / (least(count(DISTINCT lot), count(DISTINCT l_returnflag)) - 1)) AS x FROM o),
u AS (SELECT c, n, x, k FROM e UNPIVOT (x FOR n IN (l_quantity, l_extendedprice, mix)) UNPIVOT (k FOR c IN (lot, l_returnflag))),
g AS (SELECT c, n, k, count(*) AS m, avg(x) AS s FROM u GROUP BY 1, 2, 3), w AS (SELECT c, n, avg(x) AS s, var_pop(x) * count(*) AS v FROM u GROUP BY 1, 2),
h AS (SELECT g.c AS a, g.n AS b, 'eta' AS kind, sqrt(sum(m * pow(g.s - w.s, 2)) / max(v)) AS x FROM g JOIN w ON w.c = g.c AND w.n = g.n GROUP BY 1, 2)
SELECT a, b, kind, round(x, 6) AS effect FROM (FROM p UNION ALL FROM v UNION ALL FROM h) WHERE abs(x) >= 0.3""")
def column_network(spark, d):
    li = t(spark, d, "lineitem").withColumn("mix", F.col("l_quantity") * 1000 + F.col("l_extendedprice")).withColumn("lot", F.when(F.col("l_quantity") > 25, "many").otherwise("few"))
    return review.column_network(li, ["l_quantity", "l_extendedprice", "mix"], ["lot", "l_returnflag"]).select("a", "b", "kind", r("effect", 6))


# -- charts -------------------------------------------------------------------


@query("""WITH q AS (SELECT o_orderpriority AS g, count(*) AS n, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders GROUP BY 1)
SELECT g AS "group", any_value(n) AS n, round(any_value(q[1]), 4) AS q1, round(any_value(q[2]), 4) AS median, round(any_value(q[3]), 4) AS q3, min(o_totalprice) FILTER (o_totalprice >= q[1] - 1.5 * (q[3] - q[1])) AS low_whisker, max(o_totalprice) FILTER (o_totalprice <= q[3] + 1.5 * (q[3] - q[1])) AS high_whisker,
count(*) FILTER (o_totalprice < q[1] - 1.5 * (q[3] - q[1]) OR o_totalprice > q[3] + 1.5 * (q[3] - q[1])) AS outliers FROM orders JOIN q ON g = o_orderpriority GROUP BY 1""")
def box(spark, d):
    return charts.box(t(spark, d, "orders"), "o_totalprice", "o_orderpriority").select("group", "n", r("q1", 4), r("median", 4), r("q3", 4), "low_whisker", "high_whisker", "outliers")


@query("""WITH a AS (SELECT p_brand AS k FROM part GROUP BY 1 ORDER BY count(*) DESC, k LIMIT 5), b AS (SELECT p_type AS k FROM part GROUP BY 1 ORDER BY count(*) DESC, k LIMIT 3)
SELECT coalesce(a.k, 'Other') AS x, coalesce(b.k, 'Other') AS y, count(*) AS n FROM part LEFT JOIN a ON a.k = p_brand LEFT JOIN b ON b.k = p_type GROUP BY 1, 2""")
def crosstab(spark, d):
    return charts.crosstab(t(spark, d, "part"), "p_brand", "p_type", 5, 3)


@query("""WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS f FROM lineitem)
SELECT CAST(greatest(0, least(9, floor((l_quantity - a) * 10 / (b - a)))) AS INTEGER) AS bx, CAST(greatest(0, least(9, floor((l_extendedprice - c) * 10 / (f - c)))) AS INTEGER) AS "by", count(*) AS n FROM lineitem, e GROUP BY 1, 2""")
def grid(spark, d):
    return charts.grid(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 10)


@query("""SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS mean, round(avg(o_totalprice) - stddev_samp(o_totalprice) / sqrt(count(*)), 2) AS low, round(avg(o_totalprice) + stddev_samp(o_totalprice) / sqrt(count(*)), 2) AS high FROM orders GROUP BY 1""")
def error_bars(spark, d):
    return charts.error_bars(t(spark, d, "orders"), "o_totalprice", "o_orderpriority", "se").select("o_orderpriority", "n", r("mean"), r("low"), r("high"))


@query()
def error_bars_bootstrap(spark, d):
    return charts.bootstrap(t(spark, d, "supplier"), "s_acctbal", "s_nationkey")


@query("""SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem""")
def linear_fit(spark, d):
    return charts.linear_fit(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(r("slope", 4), r("intercept"), r("r2", 6), "n")


@query("""SELECT count(l_tax) AS n, round(sum(l_tax), 2) AS sum, round(avg(l_tax), 6) AS mean, round(stddev_samp(l_tax), 6) AS sd, round(median(l_tax), 6) AS median FROM lineitem""")
def chart_summary(spark, d):
    return charts.summary(t(spark, d, "lineitem"), "l_tax").select("n", r("sum"), r("mean", 6), r("sd", 6), r("median", 6))


@query("""WITH g AS (SELECT year(o_orderdate) AS frame, o_orderpriority AS category, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT CAST(frame AS INTEGER) AS frame, category, round(v, 2) AS value, CAST(row_number() OVER (PARTITION BY frame ORDER BY v DESC, category) AS INTEGER) AS rank FROM g""")
def chart_frames(spark, d):
    return charts.frames(t(spark, d, "orders"), F.year("o_orderdate"), "o_orderpriority", "o_totalprice").select("frame", "category", r("value"), "rank")


@query("""SELECT CASE WHEN l_quantity BETWEEN 1 AND 10 THEN 'low' WHEN l_quantity BETWEEN 10 AND 30 THEN 'mid' ELSE '(outside)' END AS slice, count(*) AS n, round(sum(l_tax), 2) AS sum FROM lineitem GROUP BY 1""")
def chart_slices(spark, d):
    return charts.slices(t(spark, d, "lineitem"), "l_quantity", [("low", 1, 10), ("mid", 10, 30)], "l_tax").select("slice", "n", r("sum"))


@query("""WITH g AS (SELECT p_brand AS k FROM part GROUP BY 1 ORDER BY count(*) DESC, k LIMIT 5), e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
SELECT coalesce(k, 'Other') AS "group", CAST(greatest(0, least(9, floor((p_retailprice - lo) * 10 / (hi - lo)))) AS INTEGER) AS bin, count(*) AS n FROM part LEFT JOIN g ON k = p_brand, e GROUP BY 1, 2""")
def chart_grouped_bins(spark, d):
    return charts.grouped_bins(t(spark, d, "part"), "p_retailprice", "p_brand", 10)


@query("""SELECT CASE WHEN (l_quantity - 0) BETWEEN 0.5 AND 20.5 AND l_tax * 1000 BETWEEN -0.5 AND 40.5 THEN 'box' END AS region, count(*) AS n FROM lineitem GROUP BY 1""")
def region_points(spark, d):
    li = t(spark, d, "lineitem").withColumn("y", F.col("l_tax") * 1000)
    ring = [(0.5, -0.5), (20.5, -0.5), (20.5, 40.5), (0.5, 40.5)]
    return charts.points_in_polygons(li, "l_quantity", "y", [("box", [ring])]).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


# -- time series --------------------------------------------------------------


@query("""SELECT event_type AS series, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, round(avg(value), 4) AS value FROM events GROUP BY 1, 2""")
def ts_aggregate(spark, d):
    s = timeseries.series(t(spark, d, "events"), "ts", "value", "day", "mean", by="event_type")
    return s.select("series", buckets.bucket_label(F.col("slot"), "day").alias("day"), r("value", 4))


@query("""WITH g AS (SELECT date_trunc('day', ts) AS b, sum(value) AS s FROM events GROUP BY 1) SELECT strftime(b, '%Y-%m-%d') AS day, CASE WHEN count(s) OVER w >= 4 THEN round(avg(s) OVER w, 4) END AS smooth FROM g WINDOW w AS (ORDER BY b ROWS 6 PRECEDING)""")
def ts_rolling(spark, d):
    s = timeseries.regular(timeseries.series(t(spark, d, "events"), "ts", "value", "day"), "day")
    return timeseries.rolling(s, 7).select(buckets.bucket_label(F.col("slot"), "day").alias("day"), r("smooth", 4))


@query("""WITH h AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events WHERE value IS NOT NULL), g AS (SELECT *, CAST(floor(epoch(nx - ts)) AS BIGINT) AS s FROM h), u AS (SELECT user_id, median(s) AS usual FROM g GROUP BY 1),
e AS (SELECT user_id, ts, value, ts + to_seconds(CAST(floor(coalesce(least(s, 3 * usual), usual, 1)) AS BIGINT)) AS z FROM g JOIN u USING (user_id)),
c AS (SELECT user_id, value, ts, z, unnest(generate_series(date_trunc('day', ts), date_trunc('day', z), INTERVAL 1 DAY)) AS slot FROM e),
w AS (SELECT user_id, slot, value, CAST(floor(epoch(least(z, slot + INTERVAL 1 DAY) - greatest(ts, slot))) AS BIGINT) AS w FROM c)
SELECT user_id, strftime(slot, '%Y-%m-%d') AS slot, round(sum(value * w) / sum(w), 4) AS value FROM w WHERE w > 0 GROUP BY 1, 2""")
def ts_time_weighted(spark, d):
    out = timeseries.time_weighted_mean(t(spark, d, "events"), "ts", "value", "day", "user_id", then=("event_id",))
    return out.select("user_id", buckets.bucket_label(F.col("slot"), "day").alias("slot"), r("value", 4))


@query()
def ts_decompose(spark, d):
    s = timeseries.series(t(spark, d, "orders"), "o_orderdate", "o_totalprice", "month", by="o_orderstatus")
    return timeseries.decompose_frame(timeseries.regular(s, "month", by="series"), 12)


@query()
def ts_forecast(spark, d):
    s = timeseries.series(t(spark, d, "orders"), "o_orderdate", "o_totalprice", "month", by="o_orderstatus")
    return timeseries.forecast(timeseries.regular(s, "month", by="series"), 6, 12)


@query("""SELECT strftime(ts, '%a') AS label, count(value) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median FROM events GROUP BY 1""")
def ts_typical_week(spark, d):
    return timeseries.typical(t(spark, d, "events"), "ts", "value", "dow").select("label", "n", r("mean", 4), r("median", 4))


@query("""WITH a AS (SELECT ts, count(*) AS n FROM events GROUP BY 1), b AS (SELECT ts, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT '(all)' AS key, round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 6) AS repeated FROM a UNION ALL SELECT 'event_type', round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 6) FROM b""")
def ts_shape_check(spark, d):
    return timeseries.shape_check(t(spark, d, "events"), "ts", ["event_type"]).select("key", r("repeated", 6))


@query(_VERSIONS + """SELECT 'o_totalprice' AS "column", count(*) FILTER (a.o_totalprice <> b.o_totalprice) AS changed, round(count(*) FILTER (a.o_totalprice <> b.o_totalprice) / count(*), 6) AS share FROM a JOIN b ON a.o_orderkey = b.o_orderkey
UNION ALL SELECT 'o_orderstatus', 0, 0.0""")
def compare_report(spark, d):
    a, b = _versions(spark, d)
    order = lambda df: df.withColumn("_row_id", F.col("o_orderkey"))
    m = compare.match(order(a), order(b), ["o_orderkey"], "_row_id", ["o_orderkey", "o_totalprice", "o_orderstatus"])
    return compare.report(m, ["o_totalprice", "o_orderstatus"]).select("column", "changed", r("share", 6))


@query(_VERSIONS + """SELECT round(sum(a.o_totalprice), 2) AS sum_a, (SELECT round(sum(o_totalprice), 2) FROM b) AS sum_b, round(sum(a.o_totalprice) FILTER (b.o_orderkey IS NOT NULL), 2) AS matched_a, round(sum(b.o_totalprice), 2) AS matched_b FROM a LEFT JOIN b ON a.o_orderkey = b.o_orderkey""")
def compare_totals(spark, d):
    a, b = _versions(spark, d)
    order = lambda df: df.withColumn("_row_id", F.col("o_orderkey"))
    return compare.side_totals(compare.match(order(a), order(b), ["o_orderkey"], "_row_id", ["o_orderkey", "o_totalprice"]), "o_totalprice").select(r("sum_a"), r("sum_b"), r("matched_a"), r("matched_b"))


@query("""SELECT 'c_name' AS a, 'customer' AS b, CAST(1 AS DOUBLE) AS overlap""")
def compare_rename(spark, d):
    a = t(spark, d, "customer").select("c_name", "c_mktsegment")
    return compare.suggest_renames(a, a.withColumnsRenamed({"c_name": "customer", "c_mktsegment": "segment"}), ["c_name", "c_mktsegment"], ["customer", "segment"])


@query("""WITH m AS (SELECT median(c_acctbal) AS m FROM customer), s AS (SELECT median(abs(c_acctbal - m)) AS mad FROM customer, m)
SELECT c_custkey, CASE WHEN c_acctbal < m - 3.5 / 0.6745 * mad OR c_acctbal > m + 3.5 / 0.6745 * mad THEN 'Yes' ELSE 'No' END AS odd FROM customer, m, s""")
def flag_anomalies(spark, d):
    return transforms.flag_anomalies(t(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "odd").select("c_custkey", "odd")


@query("""SELECT n_name AS region, count(*) AS n, round(sum(c_acctbal), 2) AS sum, round(median(c_acctbal), 2) AS median FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def region_aggregate(spark, d):
    c = t(spark, d, "customer").join(F.broadcast(t(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return charts.region_aggregate(c, F.col("n_name"), "c_acctbal").select("region", "n", r("sum"), r("median"))


@query("""WITH e AS (SELECT quantile_cont(l_quantity, [0.01, 0.99]) AS x, quantile_cont(l_extendedprice, [0.01, 0.99]) AS y FROM lineitem)
SELECT CAST(greatest(0, least(9, floor((l_quantity - x[1]) * 10 / (x[2] - x[1])))) AS INTEGER) AS bx, CAST(greatest(0, least(9, floor((l_extendedprice - y[1]) * 10 / (y[2] - y[1])))) AS INTEGER) AS "by", count(*) AS n FROM lineitem, e
WHERE l_quantity BETWEEN x[1] AND x[2] AND l_extendedprice BETWEEN y[1] AND y[2] GROUP BY 1, 2""")
def chart_density(spark, d):
    return charts.density(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 10)


@query("""SELECT 'c_custkey' AS "column", true AS identifier UNION ALL SELECT 'c_mktsegment', false""")
def dq_identifiers(spark, d):
    return profile.identifier_like(t(spark, d, "customer"), ["c_custkey", "c_mktsegment"])


@query("""WITH v AS (SELECT DISTINCT CAST(o_orderkey + 4111111111111111 AS VARCHAR) AS v FROM orders), g AS (SELECT v, length(v) - i AS back, CAST(substr(v, i, 1) AS INTEGER) AS dg FROM (SELECT v, unnest(range(1, length(v) + 1)) AS i FROM v)),
c AS (SELECT v FROM g GROUP BY 1 HAVING sum(CASE WHEN back % 2 = 0 THEN dg WHEN dg > 4 THEN dg * 2 - 9 ELSE dg * 2 END) % 10 = 0)
SELECT 'card' AS kind, count(*) AS n FROM c UNION ALL SELECT 'iban', 0 UNION ALL SELECT 'abn', 0 UNION ALL SELECT 'tfn', 0""")
def pii_check_digits(spark, d):
    return profile.checked_numbers(t(spark, d, "orders").select((F.col("o_orderkey") + 4111111111111111).alias("k")), "k")


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 5 <> 0) AS mails, count(*) FILTER (c_custkey % 4 = 0) AS phones FROM customer)
SELECT 'contact_mail' AS "column", 'contact' AS "class", 'high' AS confidence, 'confidential' AS label, round(mails / n, 6) AS share FROM c UNION ALL SELECT 'mobile', 'contact', 'medium', 'confidential', round(phones / n, 6) FROM c
UNION ALL SELECT 'paid_with', 'financial', 'high', 'confidential', 1.0 UNION ALL SELECT 'remark', 'free_text', 'medium', 'confidential', round(mails / n, 6) FROM c UNION ALL SELECT 'gender', 'demographic', 'low', 'internal', 0.0""")
def pii_scan(spark, d):
    k = F.col("c_custkey")
    mail = F.concat(F.lit("user"), k.cast("string"), F.lit("@mail.example"))
    df = t(spark, d, "customer").select(
        F.when(k % 5 != 0, mail).otherwise("none").alias("contact_mail"),
        F.when(k % 4 == 0, "0412 345 678").otherwise("n").alias("mobile"),
        F.lit("4111 1111 1111 1111").alias("paid_with"),
        F.when(k % 5 != 0, F.concat(F.lit("please write to "), mail, F.lit(" soon"))).otherwise("nothing to say here").alias("remark"),
        F.lit("x").alias("gender"),
        F.col("c_mktsegment").alias("segment"),
    )
    return sensitive.scan(df).select("column", "class", "confidence", "label", r("share", 6))


@query("""WITH v AS (SELECT c_custkey AS id, c_custkey % 20 AS a, c_custkey % 20 % 6 AS b, CASE WHEN c_custkey = 77 THEN 99 ELSE c_custkey % 20 % 4 END AS c FROM customer), n AS (SELECT count(*) AS n FROM v)
SELECT 'a' AS determinant, 'b' AS dependent, n AS rows, CAST(0 AS BIGINT) AS violations FROM n UNION ALL SELECT 'a', 'c', n, CAST((SELECT count(*) FROM v WHERE c = 99) AS BIGINT) FROM n""")
def dq_dependencies(spark, d):
    k = F.col("c_custkey")
    df = t(spark, d, "customer").select(k.alias("id"), (k % 20).alias("a"), (k % 20 % 6).alias("b"), F.when(k == 77, 99).otherwise(k % 20 % 4).alias("c"))
    return profile.dependencies(df, ["a", "b", "c"], "id")


@query("""SELECT 'l_orderkey + l_linenumber' AS "column", count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber)) AS kinds, CAST(1 AS DOUBLE) AS overlap FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""")
def compare_key_pairs(spark, d):
    li = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    li = li.repartition(parts_of(li, li.count()), "l_orderkey", "l_linenumber").distinct()
    return compare.suggest_key_pairs(li, li, ["l_orderkey", "l_linenumber"]).select("column", "rows", "kinds", "overlap")


@query("""WITH g AS (SELECT user_id, ts, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events), u AS (SELECT user_id, median(floor(gap)) AS usual FROM g WHERE floor(gap) > 0 GROUP BY 1),
n AS (SELECT user_id, date_trunc('week', ts) AS slot, count(*) AS n FROM events GROUP BY 1, 2), e AS (SELECT n.user_id, slot, n, least(1, n * usual / 604800) AS coverage, slot = min(slot) OVER w OR slot = max(slot) OVER w AS edge FROM n JOIN u ON u.user_id = n.user_id WINDOW w AS (PARTITION BY n.user_id))
SELECT CAST(user_id AS VARCHAR) AS series, strftime(slot, '%Y-%m-%d') AS slot, n, round(coverage, 6) AS coverage, edge AND coverage < 0.95 AS partial FROM e""")
def ts_coverage(spark, d):
    out = timeseries.coverage(t(spark, d, "events"), "ts", "week", "user_id")
    return out.select("series", F.date_format("slot", "yyyy-MM-dd").alias("slot"), "n", r("coverage", 6), "partial")


@query("""WITH v AS (SELECT o_orderstatus AS series, date_trunc('month', o_orderdate) AS slot, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2), e AS (SELECT min(o_orderdate) AS a, max(o_orderdate) AS z FROM orders),
s AS (SELECT min(slot) AS a, max(slot) AS z FROM v), f AS (SELECT s.a, s.z, (epoch(s.a + INTERVAL 1 MONTH) - floor(epoch(e.a))) / (epoch(s.a + INTERVAL 1 MONTH) - epoch(s.a)) AS first, (floor(epoch(e.z)) - epoch(s.z)) / (epoch(s.z) - epoch(s.z - INTERVAL 1 MONTH)) AS last FROM s, e)
SELECT series, strftime(slot, '%Y-%m-%d') AS slot, round(value, 2) AS value, slot = f.a AND first < 0.95 OR slot = f.z AND last < 0.95 AS partial FROM v, f""")
def ts_from_view(spark, d):
    o = t(spark, d, "orders")
    view = o.groupBy("o_orderstatus", F.date_trunc("month", "o_orderdate").alias("month")).agg(F.sum("o_totalprice").alias("total"))
    ends = o.agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    out = timeseries.from_view(view, "month", "total", "o_orderstatus", tuple(ends))
    return out.select("series", F.date_format("slot", "yyyy-MM-dd").alias("slot"), r("value"), "partial")


# -- plain joins (engine plumbing) --------------------------------------------


@query("""SELECT n_name AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def join_orders_by_nation(spark, d):
    o = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy(F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def join_anti(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("""SELECT lower(n_name) AS key, count(*) AS n FROM nation GROUP BY 1""")
def region_join_key(spark, d):
    return t(spark, d, "nation").groupBy(charts.region_key(F.col("n_name")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, lower(replace(c_name, '#', '#')) AS n FROM customer""")
def normalize_names(spark, d):
    return t(spark, d, "customer").select("c_custkey", T.normalize(F.col("c_name")).alias("n"))


# -- breaks, bars, scales, casts ------------------------------------------------


@query("""WITH c AS (SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS w, sum(n * v) AS s, min(v) AS lo, max(v) AS hi FROM c),
e AS (SELECT v, sum(n) OVER w AS w0, sum(n * v) OVER w AS s0 FROM c WINDOW w AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT lo, a.v AS a, b.v AS b, hi, a.s0 * a.s0 / a.w0 + (b.s0 - a.s0) * (b.s0 - a.s0) / (b.w0 - a.w0) + (s - b.s0) * (s - b.s0) / (w - b.w0) AS gain FROM e a JOIN e b ON a.v < b.v, t WHERE a.w0 > 0),
m AS (SELECT arg_max([lo, a, b, hi], gain) AS edges FROM d) SELECT unnest(range(0, 4)) AS k, unnest(edges) AS edge FROM m""")
def breaks_natural(spark, d):
    edges = charts.class_breaks(t(spark, d, "lineitem"), "l_quantity", 3, "natural")
    return spark.createDataFrame(list(enumerate(edges)), "k bigint, edge double")


@query("""WITH o AS (SELECT o_orderpriority AS g, o_totalprice AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
b AS (SELECT g, x, k, n, greatest(0, floor(n / 2 - 0.5 * 1.959964 * sqrt(n)) - 1) AS lo, least(n - 1, ceil(n / 2 + 0.5 * 1.959964 * sqrt(n))) AS hi FROM o)
SELECT g AS o_orderpriority, any_value(n) AS n, round(median(x), 2) AS median, round(max(CASE WHEN k = lo THEN x END), 2) AS low, round(max(CASE WHEN k = hi THEN x END), 2) AS high FROM b GROUP BY 1""")
def error_bars_median(spark, d):
    return charts.median_bars(t(spark, d, "orders"), "o_totalprice", "o_orderpriority").select("o_orderpriority", "n", r("median"), r("low"), r("high"))


_SYMLOG = "sign({x}) * ln(1 + abs({x}))"


@query(f"""WITH o AS (SELECT o_orderpriority AS p, exp(o_totalprice / 10000) - 1000000 AS v FROM orders), e AS (SELECT {_SYMLOG.format(x="min(v)")} AS lo, {_SYMLOG.format(x="max(v)")} AS hi FROM o)
SELECT CAST(greatest(0, least(63, floor(({_SYMLOG.format(x="v")} - lo) / ((hi - lo) / 64)))) AS INTEGER) AS bin, count(*) AS n FROM o, e WHERE p LIKE '1%' GROUP BY 1""")
def hist_symlog(spark, d):
    o = t(spark, d, "orders").select("o_orderpriority", (F.exp(F.col("o_totalprice") / 10000) - 1000000).alias("v"))
    return filters.histogram(o.where(F.col("o_orderpriority").startswith("1")), "v", base=o, scale="auto")


_RAW_AMOUNT = "CASE o_orderkey % 6 WHEN 0 THEN '00' || o_custkey WHEN 1 THEN 'oops' WHEN 2 THEN 'n/a' WHEN 3 THEN '$' || o_custkey WHEN 4 THEN o_custkey || '.50' ELSE CAST(o_custkey AS VARCHAR) END"


def _raw_amounts(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.expr(_RAW_AMOUNT.replace("VARCHAR", "STRING")).alias("amount"))


@query(f"""WITH a AS (SELECT {_RAW_AMOUNT} AS v, o_orderkey % 6 AS k FROM orders)
SELECT count(*) FILTER (k <> 2) AS non_empty, count(*) FILTER (k = 1) AS failed, count(*) FILTER (k IN (0, 1, 3, 4)) AS changed, count(*) FILTER (k = 0) AS digits_lost, true AS applied FROM a""")
def cast_counts(spark, d):
    return transforms.cast_report(_raw_amounts(spark, d), "amount", "number").drop("examples")


@query(f"SELECT o_orderkey, {_RAW_AMOUNT} AS amount FROM orders WHERE o_orderkey % 6 IN (1, 4)")
def cast_failing_rows(spark, d):
    return transforms.cast_failures(_raw_amounts(spark, d), "amount", "integer").select("o_orderkey", "amount")


@query(f"""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 1 THEN NULL WHEN 2 THEN 'n/a' WHEN 4 THEN CAST(o_custkey AS VARCHAR) || '.5' ELSE CAST(o_custkey AS VARCHAR) END AS amount, o_orderkey % 6 = 1 AS amount_failed FROM orders""")
def cast_numbers(spark, d):
    return transforms.cast_column(_raw_amounts(spark, d), "amount", "number")


@query("""WITH p AS (SELECT row_number() OVER () AS id, string_split(p_name, ' ') AS t0, string_split(p_name || ' ' || lower(p_type), ' ') AS t1, p_type AS v, CASE WHEN starts_with(p_name, 'red') THEN 500 ELSE p_size END AS x FROM part),
w AS (SELECT id, 'p_name' AS a, unnest(t0) AS w, v, x FROM p UNION ALL SELECT id, 'label', unnest(t1), v, x FROM p),
k AS (SELECT a, w, count(*) AS n FROM w GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, w) <= 12),
f AS (SELECT k.a, k.w, p.v, p.x, list_contains(CASE WHEN k.a = 'p_name' THEN t0 ELSE t1 END, k.w) AS code FROM k, p),
g AS (SELECT a, w, code, v, count(*) AS o FROM f GROUP BY ALL), h AS (SELECT *, sum(o) OVER (PARTITION BY a, w) AS n, sum(o) OVER (PARTITION BY a, w, code) AS r, sum(o) OVER (PARTITION BY a, w, v) AS c FROM g),
e AS (SELECT a, 'p_type' AS b, 'cramer' AS kind, sqrt(sum(o * o / (r * c)) - 1) AS effect, any_value(n) AS n, w AS basis FROM h GROUP BY a, w UNION ALL
SELECT a, 'size', 'eta2', 1 - sum(o * s) / sum(o) / (SELECT var_pop(x) FROM p), sum(o), w FROM (SELECT a, w, code, count(*) AS o, var_pop(x) AS s FROM f GROUP BY ALL) GROUP BY a, w),
z AS (SELECT 'p_name' AS a, 'label' AS b, 'overlap' AS kind, sum(len(list_intersect(t0, t1))) / sum(len(list_distinct(list_concat(t0, t1)))) AS effect, count(*) AS n, NULL AS basis FROM p)
SELECT a, b, kind, round(effect, 6) AS effect, CAST(n AS BIGINT) AS n, basis FROM (SELECT e.*, k.n AS df FROM e JOIN k ON k.a = e.a AND k.w = e.basis QUALIFY row_number() OVER (PARTITION BY e.a, b ORDER BY round(effect, 9) DESC, df DESC, basis) = 1) WHERE effect >= 0.3 UNION ALL SELECT a, b, kind, round(effect, 6), n, basis FROM z""")
def text_network(spark, d):
    p = t(spark, d, "part").select("p_name", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("label"), "p_type", F.when(F.col("p_name").startswith("red"), 500).otherwise(F.col("p_size")).alias("size"))
    return review.text_network(p, ["p_name", "label"], ["p_type"], ["size"]).select("a", "b", "kind", r("effect", 6), "n", "basis")


@query("""WITH t AS (SELECT DISTINCT epoch_us(ts) AS u FROM events), g AS (SELECT u - lag(u) OVER (ORDER BY u) AS gap FROM t),
r AS (SELECT gap / 1e6 AS s, row_number() OVER (ORDER BY gap) - 1 AS k, count(*) OVER () AS n FROM g WHERE gap IS NOT NULL), m AS (SELECT s, n FROM r WHERE k = n // 2)
SELECT CAST(CASE WHEN s >= 0.75 * 86400 THEN 1440 WHEN s * 1.1 >= 3600 THEN 60 WHEN s * 1.1 >= 1800 THEN 30 WHEN s * 1.1 >= 900 THEN 15 WHEN s * 1.1 >= 300 THEN 5 ELSE 1 END AS INTEGER) AS minutes, round(s, 6) AS typical, n AS gaps FROM m""")
def ts_base_slot(spark, d):
    return timeseries.base_slot(t(spark, d, "events"), "ts").select("minutes", r("typical", 6), "gaps")
