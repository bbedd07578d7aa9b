"""The query catalogue: Spark queries over the star schema, each with its equal in SQL.

Sums of doubles are rounded, and ties broken by unique keys, so that results do not depend on the order of rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .operators import Module, Sandbox, SparkProfile, Workspace
from .plans import Description, Relation, layers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Tables:
    """Serves driver tables as exported tables of one module each, so that modules can be built over them directly."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def resolve_contract(self, name, version):
        return Description(name, version, {name: Relation(_t(self.spark, self.sf_dir, name).schema)})

    def upstream_table(self, name, version, table, schema):
        return _t(self.spark, self.sf_dir, table)


def _module(spark: SparkSession, sf_dir: str, name: str, *sources: str) -> Module:
    m = Module(name, "1.0.0", spark=spark)
    m.attach(_Tables(spark, sf_dir))
    m.source({s: "1.0.0" for s in sources})
    return m


@_query("""SELECT o_orderdate AS order_date, p_type AS product_category, r_name AS region_name, round(sum(l_extendedprice), 2) AS sales_amount_sum
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def star_join_daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales by day, category and region: facts joined with their dimensions, built and read back as a module's tables."""
    m = _module(spark, sf_dir, "daily", "lineitem", "orders", "customer", "part", "nation", "region")
    up = m.upstream
    line = up["lineitem"].get("lineitem", {"order_id": "l_orderkey", "product_id": "l_partkey", "sales_amount": "l_extendedprice"})
    order = up["orders"].get("orders", {"order_id": "o_orderkey", "customer_id": "o_custkey", "order_date": "o_orderdate"})
    place = up["nation"].get("nation", {"nation_id": "n_nationkey", "region_id": "n_regionkey"}).join(up["region"].get("region", {"region_id": "r_regionkey", "region_name": "r_name"}), "region_id")
    buyer = up["customer"].get("customer", {"customer_id": "c_custkey", "nation_id": "c_nationkey"}).join(place, "nation_id")
    product = up["part"].get("part", {"product_id": "p_partkey", "product_category": "p_type"})
    # which dimensions are broadcast is decided by their measured sizes
    star = line.join(product, "product_id").join(order, "order_id").join(buyer, "customer_id")
    m.sink_internal({"staging": star.groupBy("order_date", "product_category", "region_name").agg(F.round(F.sum("sales_amount"), 2).alias("sales_amount_sum"))})
    m.flow()
    m.sink({"daily": m.get("staging", {c: c for c in ("order_date", "product_category", "region_name", "sales_amount_sum")})})
    m.build()
    return m.tables["daily"].frame


@_query("SELECT o_orderkey AS id, o_custkey AS buyer, o_custkey AS payer, o_orderstatus AS status FROM orders")
def scan_select_alias(spark, sf_dir):
    m = _module(spark, sf_dir, "scan", "orders")
    return m.upstream["orders"].get("orders", {"id": "o_orderkey", "buyer": "o_custkey", "payer": "o_custkey", "status": "o_orderstatus"})


@_query("SELECT r_regionkey AS region_id, r_name AS region_name FROM region")
def passthrough_module(spark, sf_dir):
    m = _module(spark, sf_dir, "regions", "region")
    m.sink({"regions": m.upstream["region"].get("region", {"region_id": "r_regionkey", "region_name": "r_name"})})
    m.build()
    return m.tables["regions"].frame


_METERS = """
from loomline import Module
def module():
    m = Module("meters", "1.0.0")
    m.sink({"readings": m.spark.createDataFrame([("north", 1, 4), ("north", 2, 9), ("south", 1, 17)], "site string, hour int, litres long")})
    return m
"""
_USAGE = """
from pyspark.sql import functions as F
from loomline import Module
def module():
    m = Module("usage", "1.0.0")
    m.source({"meters": "1.0.0"})
    m.sink({"by_site": m.upstream["meters"].get("readings", {"place": "site", "used": "litres"}).groupBy("place").agg(F.sum("used").alias("total"), F.lit(m.spark.conf.get("spark.sql.shuffle.partitions")).alias("partitions"))})
    return m
"""
_EXPORT = """
from pyspark.sql import functions as F
from loomline import Module
def module():
    m = Module("export", "1.0.0")
    m.source({"orders": "1.0.0"})
    m.sink({"orders": m.upstream["orders"].get("orders", {"id": "o_orderkey", "priority": "o_orderpriority", "price": "o_totalprice"})})
    return m
"""


def _workspace(spark: SparkSession, *codes: str) -> Workspace:
    """A workspace in the session's shared folder (for its tables) and a folder of the driver (for code and state)."""
    home = Path(tempfile.mkdtemp(prefix="loomline-"))
    shared = spark.conf.get("spark.checkpoint.dir", None) or str(home)
    w = Workspace(f"{shared.rstrip('/')}/{home.name}", home=home / "home")
    for code in codes:
        name = code.split('Module("')[1].split('"')[0]
        (home / name / "1.0.0").mkdir(parents=True)
        (home / name / "1.0.0" / "module.py").write_text(code)
        w.set_module(f"{name}@1.0.0", home / name / "1.0.0")
    w.set_profile("local", SparkProfile("local" if spark.sparkContext.master.startswith("local") else "cluster"))
    w.set_default_profile("local")
    return w


def _example(spark: SparkSession):
    """Two modules, and their graph."""
    w = _workspace(spark, _METERS, _USAGE)
    return w, w.graph({"usage": "1.0.0"})


@_query("SELECT 'north' AS place, 13::BIGINT AS total UNION ALL SELECT 'south', 17")
def literal_source_sum(spark, sf_dir):
    """A run of two modules: literal rows, and their sums read back from the published view."""
    _example(spark)[1].run()
    return spark.sql("SELECT place, total FROM usage__v1.by_site")


@_query("SELECT 'north' AS place, '3' AS partitions UNION ALL SELECT 'south', '3'")
def profile_run(spark, sf_dir):
    """A module that runs with the settings of its own profile."""
    w, graph = _example(spark)
    w.set_profile("narrow", SparkProfile(w.profiles["local"].kind, {"spark.sql.shuffle.partitions": "3"}))
    w.set_module_profile("usage", "narrow")
    graph.run()
    return spark.sql("SELECT place, partitions FROM usage.by_site")


@_query("SELECT 'meters' AS module, 1 AS major, '1.0.0' AS version UNION ALL SELECT 'usage', 1, '1.0.0'")
def run_ledger(spark, sf_dir):
    graph = _example(spark)[1]
    graph.run()
    return graph.state.ledger(spark)


@_query("SELECT 'usage' AS module, 'meters' AS upstream, 'readings' AS table_name, column_name FROM (VALUES ('site'), ('litres')) v(column_name)")
def column_lineage(spark, sf_dir):
    return spark.createDataFrame(_example(spark)[1].column_lineage(), "module string, upstream string, table_name string, column_name string")


@_query("SELECT * FROM (VALUES ('meters', 0), ('usage', 1)) v(module, level)")
def planned_levels(spark, sf_dir):
    """The levels of a graph's plan, as it would run."""
    plan = _example(spark)[1].plan()
    return spark.createDataFrame([(n, i) for i, level in enumerate(plan.layers) for n in level], "module string, level int")


@_query("SELECT * FROM (VALUES ('a', 0), ('b', 1), ('c', 1), ('d', 2)) v(module, level)")
def graph_levels(spark, sf_dir):
    rows = [(n, i) for i, level in enumerate(layers({"a": set(), "b": {"a"}, "c": {"a"}, "d": {"b", "c"}})) for n in level]
    return spark.createDataFrame(rows, "module string, level int")


@_query("SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string')) v(name, type)")
def contract_columns(spark, sf_dir):
    contract = _Tables(spark, sf_dir).resolve_contract("region", "1.0.0")["region"]
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in contract.schema], "name string, type string")


def _exported(spark: SparkSession, sf_dir: str) -> Workspace:
    """A workspace that holds orders, written and published by a run, with a module that reads them."""
    orders = _EXPORT.replace('m.source({"orders": "1.0.0"})', "").replace('m.upstream["orders"].get("orders", {', f'm.spark.read.parquet("{sf_dir}/orders.parquet").selectExpr(*(f"{{c}} AS {{a}}" for a, c in {{').replace('"price": "o_totalprice"})', '"price": "o_totalprice"}.items()))')
    reader = _EXPORT.replace('"export"', '"priced"').replace('"orders": "1.0.0"', '"export": "1.0.0"').replace('m.sink({"orders": m.upstream["orders"]', 'm.sink({"priced": m.upstream["export"]').replace('{"id": "o_orderkey", "priority": "o_orderpriority", "price": "o_totalprice"}', '{"level": "priority", "price": "price"}')
    w = _workspace(spark, orders, reader)
    w.graph({"priced": "1.0.0"}).run()
    return w


@_query("SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def published_view_sql(spark, sf_dir):
    """SQL over a view that a run published, after another session has opened the workspace."""
    w = _exported(spark, sf_dir)
    spark.sql("DROP VIEW export.orders")
    w.publish(spark.newSession())
    return spark.sql("SELECT priority, count(*) AS n, round(sum(price), 2) AS total FROM export.orders GROUP BY priority")


@_query("SELECT o_orderpriority AS priority, o_totalprice AS price FROM orders")
def infer_select_sample(spark, sf_dir):
    """A sandbox's input: the columns of a stored table that the module under development reads."""
    w = _exported(spark, sf_dir)
    return Sandbox(w.module_path("priced", "1.0.0"), w, "priced", "1.0.0", spark=spark).upstream["export"].get("orders", infer_select=True).frame


@_query("SELECT o_orderpriority AS level, max(o_totalprice) AS price FROM orders GROUP BY ALL")
def sandbox_flow(spark, sf_dir):
    """A module run over saved inputs alone: of each priority the dearest order."""
    w = _exported(spark, sf_dir)
    box = Sandbox(w.module_path("priced", "1.0.0"), w, "priced", "1.0.0", spark=spark)
    box.sink(box.upstream["export"].get("orders").transform(lambda d: d.groupBy("priority").agg(F.max("price").alias("price"))))
    box.materialize(registry=w.home / "registry.json")
    box.flow()
    return box.get("priced")


@_query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL")
def staged_then_exported(spark, sf_dir):
    m = _module(spark, sf_dir, "staged", "orders")
    m.sink_internal({"staged": m.upstream["orders"].get("orders", {"priority": "o_orderpriority"}).groupBy("priority").agg(F.count("*").alias("n"))})
    m.flow()
    m.sink({"out": m.get("staged", {"priority": "priority", "n": "n"})})
    m.build()
    return m.tables["out"].frame


def _simple(name: str, spark_query: Callable[[Callable[[str], DataFrame]], DataFrame], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark_query(lambda t: _t(spark, sf_dir, t))

    run.__name__ = name
    _query(sql)(run)


_c = F.col
_simple("global_sum", lambda t: t("lineitem").agg(F.round(F.sum("l_quantity"), 2).alias("total")), "SELECT round(sum(l_quantity), 2) AS total FROM lineitem")
_simple("global_count", lambda t: t("lineitem").agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM lineitem")
_simple("filter_predicates", lambda t: t("orders").where((_c("o_orderstatus") == "F") & (_c("o_totalprice") > 1000) & _c("o_custkey").isNotNull()).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 AND o_custkey IS NOT NULL")
_simple("case_in_between_like", lambda t: t("part").where(_c("p_size").between(5, 20) & _c("p_brand").like("Brand%")).select("p_partkey", F.when(_c("p_size") < 10, "small").otherwise("large").alias("kind"), _c("p_size").isin(5, 6).alias("least")), "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' ELSE 'large' END AS kind, p_size IN (5, 6) AS least FROM part WHERE p_size BETWEEN 5 AND 20 AND p_brand LIKE 'Brand%'")
_urgent = "SELECT * FROM orders WHERE o_orderpriority LIKE '1%'"
_first = lambda t: t("orders").where(_c("o_orderpriority").like("1%"))
_simple("left_join_counts", lambda t: t("customer").join(_first(t), _c("c_custkey") == _c("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n")), f"SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN ({_urgent}) o ON c_custkey = o_custkey GROUP BY ALL")
_simple("full_join", lambda t: t("nation").join(t("supplier"), _c("n_name") == _c("s_name"), "full").select("n_nationkey", "s_suppkey"), "SELECT n_nationkey, s_suppkey FROM nation FULL JOIN supplier ON n_name = s_name")
_simple("semi_join", lambda t: t("customer").join(_first(t), _c("c_custkey") == _c("o_custkey"), "left_semi").select("c_custkey"), f"SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM ({_urgent}) o WHERE o_custkey = c_custkey)")
_simple("anti_join", lambda t: t("customer").join(_first(t), _c("c_custkey") == _c("o_custkey"), "left_anti").select("c_custkey"), f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM ({_urgent}) o WHERE o_custkey = c_custkey)")
_simple("range_join", lambda t: t("part").join(t("region"), (_c("p_size") >= _c("r_regionkey") * 10) & (_c("p_size") < _c("r_regionkey") * 10 + 10)).groupBy("r_name").agg(F.count("*").alias("n")), "SELECT r_name, count(*) AS n FROM part JOIN region ON p_size >= r_regionkey * 10 AND p_size < r_regionkey * 10 + 10 GROUP BY ALL")


def _asof(t):
    """Each view's last purchase of the same user before it: one shuffle by user, no pairs."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = t("events").withColumn("last_purchase", F.max(F.when(_c("event_type") == "purchase", _c("ts"))).over(w))
    return e.where("event_type = 'view'").select("event_id", "last_purchase")


_simple("asof_last_event", _asof, "SELECT event_id, last_purchase FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events) WHERE event_type = 'view'")
_simple("agg_stats", lambda t: t("lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.round(F.stddev("l_quantity"), 4).alias("sd"), F.count_if(_c("l_discount") > 0.05).alias("discounted")), "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 4) AS mean, min(l_quantity) AS least, max(l_quantity) AS most, round(stddev_samp(l_quantity), 4) AS sd, count(*) FILTER (l_discount > 0.05) AS discounted FROM lineitem GROUP BY ALL")
_simple("count_distinct", lambda t: t("lineitem").groupBy("l_linestatus").agg(F.countDistinct("l_partkey").alias("parts")), "SELECT l_linestatus, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ALL")
_simple("having", lambda t: t("orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12"), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 12")
for _kind in ("rollup", "cube"):
    _simple(_kind, lambda t, k=_kind: getattr(t("orders"), k)("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")), f"SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY {_kind.upper()} (o_orderstatus, o_orderpriority)")
_simple("grouping_sets", lambda t: t("orders").groupingSets([["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")), "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")


def _w():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


_over = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_simple("rank_per_group", lambda t: t("orders").select("o_orderkey", F.row_number().over(_w()).alias("rn"), F.ntile(4).over(_w()).alias("quarter")), f"SELECT o_orderkey, (row_number() {_over}))::INTEGER AS rn, (ntile(4) {_over}))::INTEGER AS quarter FROM orders")
_simple("lag_lead", lambda t: t("orders").select("o_orderkey", F.lag("o_orderkey").over(_w()).alias("before"), F.lead("o_orderkey").over(_w()).alias("after")), f"SELECT o_orderkey, lag(o_orderkey) {_over}) AS before, lead(o_orderkey) {_over}) AS after FROM orders")
_simple("running_sum", lambda t: t("orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(_w().rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running")), f"SELECT o_orderkey, round(sum(o_totalprice) {_over} ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
_simple("rows_frame_avg", lambda t: t("orders").select("o_orderkey", F.round(F.avg("o_totalprice").over(_w().rowsBetween(-2, 0)), 3).alias("mean3")), f"SELECT o_orderkey, round(avg(o_totalprice) {_over} ROWS 2 PRECEDING), 3) AS mean3 FROM orders")
_simple("topk", lambda t: t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_simple("topk_per_group", lambda t: t("orders").withColumn("rn", F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("rn <= 3").select("o_orderpriority", "o_orderkey", "rn"), "SELECT o_orderpriority, o_orderkey, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey))::INTEGER AS rn FROM orders QUALIFY rn <= 3")
for _name, _f, _op in (("union_all", "unionAll", "UNION ALL"), ("union_distinct", "union", "UNION"), ("intersect", "intersect", "INTERSECT"), ("except", "subtract", "EXCEPT")):
    _simple(_name, lambda t, f=_f, d=_name == "union_distinct": (lambda x: x.distinct() if d else x)(getattr(t("customer").select(_c("c_nationkey").alias("k")), f)(t("part").select(_c("p_size").alias("k")))), f"SELECT c_nationkey AS k FROM customer {_op} SELECT p_size FROM part")
_simple("string_fns", lambda t: t("customer").select("c_custkey", F.upper("c_mktsegment").alias("up"), F.substring("c_name", 1, 4).alias("head"), F.concat_ws("-", "c_name", "c_mktsegment").alias("both"), F.length("c_name").alias("size"), F.regexp_extract("c_name", "([0-9]+)", 1).alias("digits")), "SELECT c_custkey, upper(c_mktsegment) AS up, c_name[1:4] AS head, concat_ws('-', c_name, c_mktsegment) AS both, length(c_name)::INTEGER AS size, regexp_extract(c_name, '([0-9]+)', 1) AS digits FROM customer")
_simple("date_trunc_month", lambda t: t("orders").groupBy(F.trunc(_c("o_orderdate").cast("date"), "month").alias("month")).agg(F.count("*").alias("n")), "SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders GROUP BY ALL")
_simple("math_fns", lambda t: t("lineitem").groupBy(F.floor("l_quantity").alias("q")).agg(F.round(F.sum(F.sqrt("l_extendedprice")), 1).alias("roots"), F.sum(F.pmod(_c("l_orderkey"), F.lit(7))).alias("rest")), "SELECT floor(l_quantity)::BIGINT AS q, round(sum(sqrt(l_extendedprice)), 1) AS roots, sum(l_orderkey % 7)::BIGINT AS rest FROM lineitem GROUP BY ALL")
_simple("array_fns", lambda t: t("embeddings").select("vec_id", F.size("embedding").alias("n"), F.element_at("embedding", 1).alias("first"), F.size(F.filter("embedding", lambda x: x > 0)).alias("positive")), "SELECT vec_id, len(embedding)::INTEGER AS n, embedding[1] AS first, len(list_filter(embedding, lambda x: x > 0))::INTEGER AS positive FROM embeddings")
_simple("json_extract", lambda t: t("events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n")), "SELECT (props::JSON->>'k')::INTEGER AS k, count(*) AS n FROM events GROUP BY ALL")


def _events(t):
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


_user = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
_simple("distinct", lambda t: t("part").select("p_brand", "p_type").distinct(), "SELECT DISTINCT p_brand, p_type FROM part")
_simple("quantiles", lambda t: t("orders").groupBy("o_orderpriority").agg(F.round(F.percentile("o_totalprice", 0.5), 3).alias("median"), F.round(F.percentile("o_totalprice", 0.9), 3).alias("p90"), F.round(F.var_samp("o_custkey"), 2).alias("spread")), "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 3) AS median, round(quantile_cont(o_totalprice, 0.9), 3) AS p90, round(var_samp(o_custkey), 2) AS spread FROM orders GROUP BY ALL")
_simple("string_agg", lambda t: t("nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names")), "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY ALL")
_simple("filtered_agg", lambda t: t("events").groupBy("event_type").agg(F.count_if(_c("value") > 50).alias("large"), F.max_by("event_id", F.struct("value", "event_id")).alias("greatest")), "SELECT event_type, count(*) FILTER (value > 50) AS large, (max({'v': value, 'i': event_id})).i AS greatest FROM events GROUP BY ALL")
_simple("pivot", lambda t: t("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).select("o_orderpriority", *(F.coalesce(s, F.lit(0)).alias(f"n_{s.lower()}") for s in "FOP")), "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS n_{s.lower()}" for s in "FOP") + " FROM orders GROUP BY ALL")
_simple("rank_kinds", lambda t: t("events").select("event_id", *(f().over(Window.partitionBy("user_id").orderBy("event_type")).alias(n) for n, f in (("r", F.rank), ("dr", F.dense_rank))), *(F.round(f().over(Window.partitionBy("user_id").orderBy("event_type")), 6).alias(n) for n, f in (("pr", F.percent_rank), ("cd", F.cume_dist)))), "SELECT event_id, (rank() OVER w)::INTEGER AS r, (dense_rank() OVER w)::INTEGER AS dr, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_type)")
_simple("first_last_nth", lambda t: t("events").select("event_id", F.first("event_id").over(_events(t)).alias("first"), F.last("event_id").over(_events(t)).alias("last"), F.nth_value("event_id", 2).over(_events(t)).alias("second")), f"SELECT event_id, first_value(event_id) {_user}) AS first, last_value(event_id) {_user}) AS last, nth_value(event_id, 2) {_user}) AS second FROM events")
_simple("range_frame_count", lambda t: t("orders").select("o_orderkey", F.count("*").over(Window.partitionBy("o_custkey").orderBy(F.unix_date(_c("o_orderdate").cast("date"))).rangeBetween(-90, 0)).alias("recent")), "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE - DATE '1970-01-01' RANGE BETWEEN 90 PRECEDING AND CURRENT ROW) AS recent FROM orders")
_simple("order_offset", lambda t: t("supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").offset(10).limit(20).select("s_suppkey", "s_acctbal"), "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 20 OFFSET 10")
for _name, _f, _op in (("intersect_all", "intersectAll", "INTERSECT ALL"), ("except_all", "exceptAll", "EXCEPT ALL")):
    _simple(_name, lambda t, f=_f: getattr(t("customer").select(_c("c_nationkey").alias("k")), f)(t("supplier").select(_c("s_nationkey").alias("k"))), f"SELECT c_nationkey AS k FROM customer {_op} SELECT s_nationkey FROM supplier")
_simple("pattern_fns", lambda t: t("part").select("p_partkey", F.regexp_replace("p_brand", "[0-9]+", "#").alias("masked"), _c("p_type").rlike("^[A-M]").alias("early"), F.instr("p_name", "a").alias("at"), F.reverse("p_brand").alias("back"), F.lpad("p_brand", 12, "*").alias("padded"), F.split("p_brand", "#")[0].alias("head")), "SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', '#', 'g') AS masked, regexp_matches(p_type, '^[A-M]') AS early, instr(p_name, 'a')::INTEGER AS at, reverse(p_brand) AS back, lpad(p_brand, 12, '*') AS padded, split(p_brand, '#')[1] AS head FROM part")
_simple("date_fns", lambda t: t("orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.date_add(_c("o_orderdate").cast("date"), 30).alias("due"), F.datediff(F.lit("2002-01-01").cast("date"), _c("o_orderdate").cast("date")).alias("age"), (_c("o_orderdate") + F.expr("INTERVAL 1 DAY 2 HOURS")).alias("later")), "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, o_orderdate::DATE + 30 AS due, (DATE '2002-01-01' - o_orderdate::DATE)::INTEGER AS age, o_orderdate + INTERVAL 26 HOUR AS later FROM orders")
_simple("casts_and_conditions", lambda t: t("customer").select("c_custkey", F.substring("c_mktsegment", 1, 1).try_cast("int").alias("none"), F.regexp_extract("c_name", "([0-9]+)", 1).try_cast("int").alias("number"), F.nullif("c_nationkey", F.lit(3)).alias("nation"), F.greatest("c_acctbal", F.lit(0.0)).alias("credit"), F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("segment")), "SELECT c_custkey, TRY_CAST(c_mktsegment[1:1] AS INTEGER) AS none, TRY_CAST(regexp_extract(c_name, '([0-9]+)', 1) AS INTEGER) AS number, nullif(c_nationkey, 3) AS nation, greatest(c_acctbal, 0.0) AS credit, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS segment FROM customer")
_simple("map_struct_explode", lambda t: t("nation").select("n_nationkey", F.explode(F.create_map(F.lit("name"), "n_name", F.lit("region"), _c("n_regionkey").cast("string")))).select("n_nationkey", F.struct(_c("key").alias("k"), _c("value").alias("v")).alias("s")).select("n_nationkey", _c("s.k").alias("k"), _c("s.v").alias("v")), "SELECT n_nationkey, 'name' AS k, n_name AS v FROM nation UNION ALL SELECT n_nationkey, 'region', n_regionkey::VARCHAR FROM nation")
_simple("hash_fns", lambda t: t("customer").select("c_custkey", F.md5(_c("c_name").cast("binary")).alias("md5"), F.sha2(_c("c_name").cast("binary"), 256).alias("sha256"), F.base64(_c("c_name").cast("binary")).alias("b64"), F.hex(_c("c_name").cast("binary")).alias("hex")), "SELECT c_custkey, md5(c_name) AS md5, sha256(c_name) AS sha256, base64(c_name::BLOB) AS b64, hex(c_name::BLOB) AS hex FROM customer")
_simple("bits_and_trig", lambda t: t("part").select("p_partkey", _c("p_size").bitwiseAND(7).alias("low"), F.shiftleft("p_size", 2).alias("shifted"), F.signum(_c("p_size") - 25.0).alias("sign"), F.round(F.log(_c("p_retailprice")), 6).alias("ln"), F.round(F.sin("p_size"), 6).alias("sine"), F.ceil(_c("p_retailprice") / 100).alias("hundreds")), "SELECT p_partkey, p_size & 7 AS low, p_size << 2 AS shifted, sign(p_size - 25.0)::DOUBLE AS sign, round(ln(p_retailprice), 6) AS ln, round(sin(p_size), 6) AS sine, ceil(p_retailprice / 100)::BIGINT AS hundreds FROM part")
_simple("tumbling_windows", lambda t: t("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(_c("w.start").alias("hour"), "event_type", "n"), "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")


_simple("right_join", lambda t: t("supplier").join(t("nation"), (_c("s_nationkey") == _c("n_nationkey")) & (_c("s_acctbal") > 9000), "right").select("n_nationkey", "s_suppkey"), "SELECT n_nationkey, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 9000")
_simple("cross_join", lambda t: t("region").crossJoin(t("nation")).groupBy("r_name").agg(F.count("*").alias("n")), "SELECT r_name, count(*) AS n FROM region CROSS JOIN nation GROUP BY ALL")
_simple("theta_join", lambda t: t("nation").alias("a").join(t("region").alias("b"), _c("a.n_regionkey") > _c("b.r_regionkey")).select(_c("a.n_name").alias("nation"), _c("b.r_name").alias("region")), "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey > r_regionkey")
_simple("approx_aggregates", lambda t: t("orders").groupBy("o_orderstatus").agg((F.abs(F.approx_count_distinct("o_custkey", 0.01) - F.countDistinct("o_custkey")) <= 0.05 * F.countDistinct("o_custkey")).alias("distinct_near"), (F.abs(F.percentile_approx("o_totalprice", 0.5, 10000) - F.percentile("o_totalprice", 0.5)) <= 0.02 * F.percentile("o_totalprice", 0.5)).alias("median_near"), F.first("o_orderstatus").alias("first"), F.last("o_orderstatus").alias("last")), "SELECT o_orderstatus, true AS distinct_near, true AS median_near, o_orderstatus AS first, o_orderstatus AS last FROM orders GROUP BY ALL")
_simple("sample_rows", lambda t: t("orders").sample(0.5, 7).agg((F.count("*") > 0).alias("some"), (F.countDistinct("o_orderkey") == F.count("*")).alias("once")).join(t("orders").sample(1.0, 7).agg(F.count("*").alias("every"))), "SELECT true AS some, true AS once, count(*) AS every FROM orders")
_simple("array_family", lambda t: t("embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("head"), F.array_sort(F.slice("embedding", 1, 3)).alias("sorted"), F.size(F.array_distinct(F.transform("embedding", lambda x: x > 0))).alias("signs"), F.array_contains(F.flatten(F.array(F.array("vec_id"), F.array(F.lit(-1).cast("long")))), -1).alias("holds"), F.aggregate(F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0)), F.lit(0), lambda a, x: a + x).alias("positive")), "SELECT vec_id, embedding[1:3] AS head, list_sort(embedding[1:3]) AS sorted, len(list_distinct(list_transform(embedding, lambda x: x > 0)))::INTEGER AS signs, list_contains(flatten([[vec_id], [-1]]), -1) AS holds, list_sum(list_transform(embedding, lambda x: (x > 0)::INTEGER))::INTEGER AS positive FROM embeddings")
_simple("posexplode_rows", lambda t: t("part").select("p_partkey", F.posexplode(F.split("p_type", "")).alias("at", "letter")).groupBy("at", "letter").agg(F.count("*").alias("n")), "SELECT (i - 1)::INTEGER AS at, letter, count(*) AS n FROM (SELECT unnest(string_split(p_type, '')) AS letter, unnest(range(1, len(p_type) + 1)) AS i FROM part) GROUP BY ALL")
_simple("map_family", lambda t: t("nation").select("n_nationkey", F.map_from_entries(F.array(F.struct(F.lit("a").alias("k"), _c("n_regionkey").alias("v")), F.struct(F.lit("b").alias("k"), _c("n_nationkey").alias("v")))).alias("m")).select("n_nationkey", F.array_join(F.array_sort(F.map_keys("m")), "").alias("keys"), F.aggregate(F.map_values("m"), F.lit(0), lambda a, x: a + x).alias("total"), F.element_at("m", "a").alias("region")), "SELECT n_nationkey, 'ab' AS keys, n_regionkey + n_nationkey AS total, n_regionkey AS region FROM nation")
_simple("struct_family", lambda t: t("nation").select("n_nationkey", F.struct(_c("n_name").alias("name"), _c("n_regionkey").alias("region")).withField("twice", _c("n_regionkey") * 2).dropFields("region").alias("s")).select("n_nationkey", "s.name", "s.twice"), "SELECT n_nationkey, n_name AS name, n_regionkey * 2 AS twice FROM nation")
_simple("json_family", lambda t: t("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.to_json(F.struct(_c("event_type").alias("t"))).alias("j"), F.try_variant_get(F.parse_json("props"), "$.k", "int").alias("v"), F.json_tuple("props", "k").alias("text")), "SELECT event_id, (props::JSON->>'k')::INTEGER AS k, '{\"t\":\"' || event_type || '\"}' AS j, (props::JSON->>'k')::INTEGER AS v, props::JSON->>'k' AS text FROM events")
_simple("date_family", lambda t: t("events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("text"), F.to_timestamp_ntz(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("parsed"), F.dayofweek("ts").alias("day"), F.hour("ts").alias("hour"), F.timestamp_diff("HOUR", F.lit("2024-01-01").cast("timestamp_ntz"), "ts").alias("hours"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("cut")), "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS text, date_trunc('second', ts) AS parsed, (dayofweek(ts) + 1)::INTEGER AS day, hour(ts)::INTEGER AS hour, floor(epoch(ts - TIMESTAMP '2024-01-01') / 3600)::BIGINT AS hours, date_trunc('hour', ts) AS cut FROM events")
_simple("null_family", lambda t: t("customer").select("c_custkey", F.least("c_acctbal", F.lit(0.0)).alias("debt"), F.ifnull(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("-")).alias("segment"), F.isnan(_c("c_acctbal")).alias("nan"), F.isnull(F.nullif("c_nationkey", F.lit(3))).alias("three")), "SELECT c_custkey, least(c_acctbal, 0.0) AS debt, ifnull(nullif(c_mktsegment, 'BUILDING'), '-') AS segment, isnan(c_acctbal) AS nan, nullif(c_nationkey, 3) IS NULL AS three FROM customer")


def _round_trip(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Nations written in another format and read back."""
        path = f"{(spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp()).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
        nation = _t(spark, sf_dir, "nation")
        write = nation.write.option("header", True) if kind == "csv" else nation.write
        write.format(kind).save(path)
        read = spark.read.schema(nation.schema)
        return (read.option("header", True) if kind == "csv" else read).format(kind).load(path)

    run.__name__ = f"read_{kind}"
    return run


for _kind in ("csv", "json", "orc"):
    _query("SELECT * FROM nation")(_round_trip(_kind))
