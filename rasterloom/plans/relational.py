"""Registered relational queries over the table set (categories that the frame codec itself lacks)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rasterloom.functions import udfs
from rasterloom.operators.relational import as_of_join, band_join, interval_join, range_join, salted_aggregate, top_k
from rasterloom.plans.catalog import _event_stream, _t, query
from rasterloom.sources import files
from rasterloom.sources.datasource import TestFrames


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def b_semi_join(spark, sf_dir):
    return _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), F.expr("o_custkey = c_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def b_anti_join(spark, sf_dir):
    return _t(spark, sf_dir, "part").join(_t(spark, sf_dir, "lineitem").where("l_quantity > 45"), F.expr("l_partkey = p_partkey"), "left_anti").select("p_partkey", "p_brand")


@query("SELECT n.n_name, count(s_suppkey) AS suppliers, count(c_custkey) AS customers FROM nation n LEFT JOIN supplier ON s_nationkey = n_nationkey FULL JOIN customer ON c_nationkey = n_nationkey GROUP BY n.n_name")
def b_outer_joins(spark, sf_dir):
    """All matches of the outer joins, counted from one row per nation and side, so that no product of rows is made."""
    s = _t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("s_rows"), F.count("s_suppkey").alias("s_keys"))
    c = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c_rows"), F.count("c_custkey").alias("c_keys"))
    n = _t(spark, sf_dir, "nation").join(s, F.expr("s_nationkey = n_nationkey"), "left")
    d = n.join(c, F.expr("c_nationkey = n_nationkey"), "full")
    suppliers, customers = F.expr("coalesce(s_keys, 0) * coalesce(c_rows, 1)"), F.expr("coalesce(c_keys, 0) * coalesce(s_rows, 1)")
    return d.groupBy("n_name").agg(F.sum(suppliers).alias("suppliers"), F.sum(customers).alias("customers"))


@query("SELECT e.event_id, e.user_id, (SELECT max(p.event_id) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.event_id <= e.event_id) AS purchase_id FROM events e WHERE e.event_type = 'error'")
def b_as_of_join(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("at"), "event_type", "event_id")
    bought = e.where("event_type = 'purchase'").select("user_id", "at", F.col("event_id").alias("purchase_id"))
    return as_of_join(e.where("event_type = 'error'"), bought, ["user_id"], "at", ["purchase_id"]).select("event_id", "user_id", "purchase_id")


@query("SELECT b.lo, count(*) AS n FROM (SELECT DISTINCT floor(p_retailprice / 40) * 40 AS lo, floor(p_retailprice / 40) * 40 + 25 AS hi FROM part) b JOIN part p ON p.p_retailprice >= b.lo AND p.p_retailprice < b.hi GROUP BY b.lo")
def b_range_join(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_retailprice")
    lo = F.floor(F.col("p_retailprice") / 40).cast("double") * 40
    spans = p.select(lo.alias("lo"), (lo + 25).alias("hi")).distinct()
    return range_join(p, spans, "p_retailprice", "lo", "hi", 40.0).groupBy("lo").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def b_cube(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("q"))


@query("SELECT o_custkey, o_orderkey, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def b_top_k(spark, sf_dir):
    return top_k(_t(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query(
    "SELECT event_id, event_type, CAST(ntile(4) OVER w AS INTEGER) AS quarter, lead(event_id, 2) OVER w AS ahead, first_value(event_id) OVER w AS first_id, CAST(count(*) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS near FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)"
)
def b_windows(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy("event_id")
    return _t(spark, sf_dir, "events").select("event_id", "event_type", F.ntile(4).over(w).alias("quarter"), F.lead("event_id", 2).over(w).alias("ahead"), F.first("event_id").over(w).alias("first_id"), F.count("*").over(w.rowsBetween(-3, 1)).alias("near"))


@query("(SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT p_partkey FROM part WHERE p_size < 20) UNION (SELECT l_suppkey FROM lineitem EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def b_set_operations(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem")
    a = line.where("l_quantity > 40").select(F.col("l_partkey").alias("k")).intersect(_t(spark, sf_dir, "part").where("p_size < 20").select("p_partkey"))
    return a.union(line.select("l_suppkey").subtract(_t(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey"))).distinct()


@query(
    "SELECT user_id, min(event_id) AS first_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) + INTERVAL 2 HOURS OR lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s"
)
def b_session_windows(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.min("event_id").alias("first_id"), F.count("*").alias("n")).select("user_id", "first_id", "n")


# Joins on inequalities


@query("SELECT a.o_orderkey, count(*) AS later FROM orders a JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderdate > a.o_orderdate AND b.o_orderdate <= a.o_orderdate + INTERVAL 30 DAYS GROUP BY a.o_orderkey")
def b_theta_band_join(spark, sf_dir):
    """How many orders the same customer placed in the 30 days after each."""
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.datediff("o_orderdate", F.lit("1970-01-01")).alias("day"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"))
    later = o.select("o_custkey", F.col("at").alias("at2"))
    width = 30 * 86_400_000_000
    return band_join(o, later, ["o_custkey"], "at", "at2", 1, width).groupBy("o_orderkey").agg(F.count("*").alias("later"))


@query(
    "WITH e AS (SELECT event_id, user_id, ts AS lo, ts + INTERVAL 6 HOURS AS hi FROM events WHERE event_type = 'error'), p AS (SELECT user_id, ts AS lo, ts + INTERVAL 12 HOURS AS hi FROM events WHERE event_type = 'purchase')"
    " SELECT e.event_id, count(*) AS n FROM e JOIN p ON e.user_id = p.user_id AND e.lo < p.hi AND p.lo < e.hi GROUP BY e.event_id"
)
def b_interval_join(spark, sf_dir):
    """Purchase spans that overlap each error span of the same user."""
    hour = 3_600_000_000
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("lo"))
    a = e.where("event_type = 'error'").select("event_id", "user_id", "lo", (F.col("lo") + 6 * hour).alias("hi"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("lo").alias("lo2"), (F.col("lo") + 12 * hour).alias("hi2"))
    return interval_join(a, b, ["user_id"], ("lo", "hi"), ("lo2", "hi2"), 12 * hour).groupBy("event_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) AS n, CAST(sum(n_lines) AS BIGINT) AS lines FROM orders JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def b_hash_merge_joins(spark, sf_dir):
    """Lines are counted before they meet their orders; both sides share the shuffle on the order key."""
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))
    d = _t(spark, sf_dir, "orders").join(lines.hint("shuffle_merge"), F.expr("l_orderkey = o_orderkey"))
    return d.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("n_lines").alias("lines"))


@query("SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, n_name")
def b_broadcast_joins(spark, sf_dir):
    """Dimensions of a fixed size (25 and 5 rows) travel to the customers."""
    d = _t(spark, sf_dir, "customer").join(F.broadcast(_t(spark, sf_dir, "nation")), F.expr("n_nationkey = c_nationkey")).join(F.broadcast(_t(spark, sf_dir, "region")), F.expr("r_regionkey = n_regionkey"))
    return d.groupBy("r_name", "n_name").agg(F.count("*").alias("n"))


# Aggregates


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS numbers, count(*) FILTER (WHERE l_quantity > 25) AS large, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def b_distinct_aggregates(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.sum_distinct("l_linenumber").alias("numbers"),
        F.count_if(F.col("l_quantity") > 25).alias("large"), F.count("*").alias("n"),
    )


@query("SELECT event_type, count(*) AS n, min(event_id) AS low, max(event_id) AS high, CAST(sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def b_partial_aggregates(spark, sf_dir):
    """Five hot keys: counts meet per (key, salt) first and per key then."""
    e = _t(spark, sf_dir, "events").select("event_type", "event_id", F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))
    return salted_aggregate(e, ["event_type"], "event_id", {"n": ("count", "event_id"), "low": ("min", "event_id"), "high": ("max", "event_id"), "total": ("sum", "k")})


@query("SELECT o_orderstatus, o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority, year(o_orderdate)), ())")
def b_grouping_sets(spark, sf_dir):
    d = _t(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.year("o_orderdate").cast("long").alias("y"))
    s, p, y = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("y")
    return d.groupingSets([(s, p), (p, y), ()], s, p, y).agg(F.count("*").alias("n")).select("o_orderstatus", "o_orderpriority", "y", "n")


# Scalars


@query(
    "SELECT p_partkey, upper(p_brand) AS up, substr(p_name, 2, 4) AS mid, replace(p_type, ' ', '_') AS under, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, reverse(p_brand) AS back, strpos(p_name, 'e') AS place, split_part(p_type, ' ', 1) AS head,"
    " regexp_replace(p_name, '[aeiou]', '#', 'g') AS masked, length(p_name) AS n, concat_ws('/', p_brand, p_type) AS joined, trim('  ' || p_brand || ' ') AS trimmed, starts_with(p_name, 'p') AS p, repeat('ab', p_size % 3) AS again, md5(p_name) AS digest, ascii(p_brand) AS first, translate(p_brand, 'Brand', 'bRAND') AS turned FROM part"
)
def b_string_functions(spark, sf_dir):
    c = F.col
    return _t(spark, sf_dir, "part").select(
        "p_partkey", F.upper("p_brand").alias("up"), F.substring("p_name", 2, 4).alias("mid"), F.replace(c("p_type"), F.lit(" "), F.lit("_")).alias("under"), F.lpad(c("p_size").cast("string"), 4, "0").alias("padded"), F.reverse("p_brand").alias("back"),
        F.instr("p_name", "e").cast("long").alias("place"), F.split_part(c("p_type"), F.lit(" "), F.lit(1)).alias("head"), F.regexp_replace("p_name", "[aeiou]", "#").alias("masked"), F.length("p_name").cast("long").alias("n"), F.concat_ws("/", "p_brand", "p_type").alias("joined"),
        F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("trimmed"), c("p_name").startswith("p").alias("p"), F.expr("repeat('ab', p_size % 3)").alias("again"), F.md5(c("p_name").cast("binary")).alias("digest"), F.ascii("p_brand").alias("first"), F.translate("p_brand", "Brand", "bRAND").alias("turned"),
    )


@query(
    "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS doy, dayofweek(o_orderdate) + 1 AS dow, strftime(o_orderdate, '%Y/%m') AS ym, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS first, CAST(last_day(o_orderdate) AS VARCHAR) AS last,"
    " CAST(CAST(o_orderdate + INTERVAL 45 DAYS AS DATE) AS VARCHAR) AS due, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days, CAST(CAST(o_orderdate - INTERVAL 3 MONTHS AS DATE) AS VARCHAR) AS back FROM orders"
)
def b_date_functions(spark, sf_dir):
    o = F.col("o_orderdate")
    long, text = (lambda c: c.cast("long")), (lambda c: c.cast("string"))
    return _t(spark, sf_dir, "orders").select(
        "o_orderkey", long(F.year(o)).alias("y"), long(F.month(o)).alias("m"), long(F.dayofmonth(o)).alias("d"), long(F.quarter(o)).alias("q"), long(F.dayofyear(o)).alias("doy"), long(F.dayofweek(o)).alias("dow"), F.date_format(o, "yyyy/MM").alias("ym"),
        text(F.date_trunc("month", o).cast("date")).alias("first"), text(F.last_day(o)).alias("last"), text(F.date_add(o, 45)).alias("due"), long(F.datediff(o, F.lit("1992-01-01"))).alias("days"), text(F.add_months(o, -3)).alias("back"),
    )


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(json_extract(props, '$.k') AS INT) * 2 AS twice, len(json_keys(props)) AS n, json_exists(props, '$.none') AS other FROM events")
def b_json_map_functions(spark, sf_dir):
    """JSON to a map, looked up and transformed."""
    m = F.from_json("props", "map<string, int>")
    d = _t(spark, sf_dir, "events").select("event_id", "props", m.alias("m"))
    doubled = F.transform_values("m", lambda k, v: v * 2)
    return d.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.element_at(doubled, "k").alias("twice"), F.size(F.map_keys("m")).cast("long").alias("n"), F.map_contains_key("m", F.lit("none")).alias("other"))


@query(
    "SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS VARCHAR) AS net, count(*) AS n, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey) AS parts, CAST(sum(CASE WHEN l_quantity > 30 THEN l_partkey ELSE 0 END) AS BIGINT) AS large,"
    " date_diff('day', CAST(min(l_shipdate) AS DATE), CAST(max(l_shipdate) AS DATE)) AS days FROM lineitem GROUP BY l_orderkey"
)
def b_decimal_interval_nested(spark, sf_dir):
    """Decimals multiplied exactly, day intervals, and arrays of structs that are built, sorted, filtered and folded."""
    net = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    g = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(net).alias("net"), F.array_sort(F.collect_list(F.struct("l_partkey", "l_quantity"))).alias("lines"), (F.max("l_shipdate").cast("date") - F.min("l_shipdate").cast("date")).alias("span"))
    parts = F.array_join(F.transform("lines", lambda x: x.l_partkey.cast("string")), ",")
    large = F.aggregate(F.filter("lines", lambda x: x.l_quantity > 30), F.lit(0).cast("long"), lambda a, x: a + x.l_partkey)
    return g.select("l_orderkey", F.col("net").cast("string").alias("net"), F.size("lines").cast("long").alias("n"), parts.alias("parts"), large.alias("large"), F.expr("extract(DAY FROM span)").cast("long").alias("days"))


# User-defined functions


@query("SELECT s_suppkey, CAST(round(s_acctbal * 100) AS BIGINT) % 97 AS checked FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT s_suppkey, -(CAST(round(-s_acctbal * 100) AS BIGINT) % 97) FROM supplier WHERE s_acctbal < 0")
def b_scalar_udf(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").select("s_suppkey", udfs.check_digits("s_acctbal").alias("checked"))


@query("SELECT event_type, round(exp(avg(ln(1 + CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)))), 6) AS mean FROM events GROUP BY event_type")
def b_aggregate_udf(spark, sf_dir):
    """A geometric mean from partial sums that combine before the shuffle, so that no key is gathered in a task."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double") + 1
    return udfs.geometric_mean(_t(spark, sf_dir, "events").select("event_type", k.alias("k")), ["event_type"], "k", "mean").withColumn("mean", F.round("mean", 6))


@query("SELECT p_partkey, CAST(n AS INT) AS place, word FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word, generate_subscripts(string_split(p_type, ' '), 1) - 1 AS n FROM part)")
def b_table_udf(spark, sf_dir):
    d = _t(spark, sf_dir, "part")
    d.select("p_partkey", "p_type").createOrReplaceTempView("_udtf_part")
    spark.udtf.register("split_words", udfs.SplitWords)
    return spark.sql("SELECT p_partkey, w.place, w.word FROM _udtf_part, LATERAL split_words(p_type) w")


# Time windows

_SIX = "(epoch_us(ts) - epoch_us(ts) % 21600000000)"


@query(f"SELECT {_SIX} AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def b_tumbling_windows(spark, sf_dir):
    from rasterloom.streaming.keyframes import windowed_counts

    d = windowed_counts(_t(spark, sf_dir, "events"), "ts", "event_type")
    return d.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n")


@query(f"SELECT * FROM (SELECT {_SIX} AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE start_us + 21600000000 <= (SELECT epoch_us(max(ts)) - 3600000000 FROM events)")
def b_watermark_windows(spark, sf_dir):
    """The same as a stream in append mode: a window comes out once the watermark, an hour behind the latest event, has passed it."""
    from rasterloom.streaming.keyframes import drain, windowed_counts

    d = windowed_counts(_event_stream(spark, sf_dir, "ts", "event_type"), "ts", "event_type")
    return drain(d.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n"), "windows")


@query(
    "SELECT (epoch_us(ts) - epoch_us(ts) % 10800000000) - k * 10800000000 AS start_us, count(*) AS n FROM events, (VALUES (0), (1)) t(k) GROUP BY ALL"
)
def b_sliding_windows(spark, sf_dir):
    d = _t(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "6 hours", "3 hours")).agg(F.count("*").alias("n"))
    return d.select(F.unix_micros("window.start").alias("start_us"), "n")


# Files


@query("SELECT f.format, s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) f(format)")
def b_file_formats(spark, sf_dir):
    """Suppliers written in each file format and read back with their schema."""
    d = _t(spark, sf_dir, "supplier")
    parts = [files.round_trip(d, kind).select(F.lit(kind).alias("format"), "*") for kind in files.FORMATS]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("SELECT f AS frame_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST((7 * x + 3 * y + 5 * f) % 256 AS INT) AS r, CAST((x + 11 * y + f) % 256 AS INT) AS g, CAST((x * y + 2 * f) % 256 AS INT) AS b FROM range(12) a(f), range(38) c(y), range(50) d(x)")
def b_data_source(spark, sf_dir):
    """Frames from the library's own data source."""
    spark.dataSource.register(TestFrames)
    return spark.read.format("testframes").options(frames=12).load()
