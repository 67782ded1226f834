"""Registered queries of the entity engine and their DuckDB twins.

Each runs through the engine's own frontends over the driver's tables, which are declared as read-only
entities. Decimal outputs are shown as doubles of four decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import normalizers as Z
from quillon.functions import validators as V
from quillon.functions.schema import EntitySchema, FieldSpec, IndexSpec, of_table
from quillon.operators.database import Database
from quillon.operators.fluent import agg, field, fn
from quillon.plans import coverage

#: Keys and indexes of the driver's tables.
KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_partkey", "l_linenumber"), "events": ("event_id",), "conversations": ("conv_id", "turn")}
INDEXES = {"orders": (IndexSpec("by_customer", ("o_custkey", "o_orderkey")), IndexSpec("by_status", ("o_orderstatus",))), "customer": (IndexSpec("by_segment", ("c_mktsegment",)), IndexSpec("by_lower_name", ("LOWER(c_name)",)))}


def database(spark: SparkSession, sf_dir: str, *names: str) -> Database:
    db = Database(spark)
    for n in names or KEYS:
        df = spark.read.parquet(f"{sf_dir}/{n}.parquet")
        db.register(of_table(n, df.schema, KEYS[n], INDEXES.get(n, ())), df)
    return db


def shown(df: DataFrame) -> DataFrame:
    """Decimals as rounded doubles."""
    return df.select(*[F.round(F.col(f"`{f.name}`").cast("double"), 4).alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`") for f in df.schema])


def sql(text: str, *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: shown(database(spark, sf_dir, *names).sql(text, max_groups=None))


#: name: (entity, the engine's SQL, DuckDB's SQL)
PAIRS: dict[str, tuple[str, str, str]] = {}


def pair(name: str, entity: str, ours: str, theirs: str | None = None) -> None:
    PAIRS[name] = (entity, ours, theirs or ours)


R = "round(CAST({} AS DOUBLE), 4)".format
D8 = "CAST({} AS DECIMAL(22,8))".format

pair("flagship", "lineitem", "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, SUM(l_extendedprice) AS sum_base, SUM(l_extendedprice * (1 - l_discount)) AS sum_disc, AVG(l_quantity) AS avg_qty, AVG(l_discount) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus",
     f"SELECT l_returnflag, l_linestatus, {R('SUM(' + D8('l_quantity') + ')')} AS sum_qty, {R('SUM(' + D8('l_extendedprice') + ')')} AS sum_base, {R('SUM(CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4))))')} AS sum_disc, round(AVG(l_quantity), 4) AS avg_qty, round(AVG(l_discount), 4) AS avg_disc, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
pair("full_scan", "nation", "SELECT * FROM nation")
pair("by_key", "orders", "SELECT * FROM orders WHERE o_orderkey = 42")
pair("by_keys", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 2, 3, 500, 500, 99999999)")
pair("key_range", "orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 100 AND 400")
pair("index_prefix", "orders", "SELECT o_orderkey FROM orders WHERE o_custkey = 7")
pair("index_multi_lookup", "customer", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
pair("index_branch_set", "orders", "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 2, 3) AND o_orderstatus = 'F'")
pair("index_range", "orders", "SELECT o_orderkey FROM orders WHERE o_custkey >= 10 AND o_custkey < 20")
pair("union_of_paths", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey < 50 OR o_custkey = 11")
pair("intersection", "orders", "SELECT o_orderkey FROM orders WHERE o_custkey < 100 AND o_orderstatus = 'O' AND o_orderkey > 100")
pair("empty_access", "orders", "SELECT o_orderkey FROM orders WHERE FALSE")
pair("field_list_alias", "customer", "SELECT c_custkey AS id, c_name name FROM customer c WHERE c.c_nationkey = 3")
pair("scalar_projection", "lineitem", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem", f"SELECT l_orderkey, l_linenumber, l_partkey, {R('CAST(l_extendedprice AS DECIMAL(18,4)) * (1 - CAST(l_discount AS DECIMAL(18,4)))')} AS net FROM lineitem")
pair("select_distinct", "orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
pair("distinct_order_limit", "lineitem", "SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem ORDER BY l_linenumber DESC, l_returnflag LIMIT 5 OFFSET 2", "SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem ORDER BY l_linenumber DESC, l_returnflag LIMIT 5 OFFSET 2")
pair("predicate_and_or_not", "orders", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 1000) AND (o_custkey > 10 OR o_orderpriority = '1-URGENT')")
pair("predicate_compare", "part", "SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size <> 20 AND p_retailprice < 1200.5")
pair("predicate_field_to_field", "lineitem", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_partkey = l_suppkey")
pair("predicate_in_null", "orders", "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 2, NULL)")
pair("predicate_not_in", "nation", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (1, 2)")
pair("predicate_not_between", "part", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45")
pair("predicate_null_tests", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus IS NOT NULL AND NULLIF(o_orderstatus, 'F') IS NULL")
pair("predicate_is_true", "orders", "SELECT o_orderkey FROM orders WHERE (o_totalprice > 100000) IS TRUE AND (o_orderstatus = 'F') IS NOT TRUE", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND NOT (o_orderstatus = 'F')")
pair("predicate_like_prefix", "customer", "SELECT c_custkey FROM customer WHERE c_name LIKE 'Customer#00000001%'")
pair("predicate_ilike_not", "part", "SELECT p_partkey FROM part WHERE p_type NOT LIKE 'PROMO%' AND p_brand ILIKE 'brand#1%'")
pair("predicate_text_functions", "customer", "SELECT c_custkey FROM customer WHERE STARTS_WITH(c_name, 'Cust') AND ENDS_WITH(c_name, '7') AND CONTAINS(LOWER(c_mktsegment), 'build')")
pair("predicate_case", "orders", "SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderstatus = 'F' THEN o_totalprice > 150000 WHEN o_orderstatus = 'O' THEN FALSE ELSE TRUE END")
pair("affine_predicate", "part", "SELECT p_partkey FROM part WHERE p_size + 5 < 12 AND p_partkey - 1 >= 10")
pair("timestamp_predicate", "events", "SELECT event_id FROM events WHERE ts >= '2024-01-01T00:00:00' AND ts < '2030-01-01'", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts < TIMESTAMP '2030-01-01'")
pair("global_aggregates", "orders", "SELECT COUNT(*) AS n, COUNT(o_orderstatus) AS c, SUM(o_totalprice) AS s, AVG(o_totalprice) AS a, MIN(o_orderdate) AS lo, MAX(o_orderdate) AS hi, MIN(o_orderpriority) AS p FROM orders", f"SELECT COUNT(*) AS n, COUNT(o_orderstatus) AS c, {R('SUM(' + D8('o_totalprice') + ')')} AS s, {R('SUM(' + D8('o_totalprice') + ')')} / COUNT(*) AS a, MIN(o_orderdate) AS lo, MAX(o_orderdate) AS hi, MIN(o_orderpriority) AS p FROM orders".replace(f"{R('SUM(' + D8('o_totalprice') + ')')} / COUNT(*) AS a", "round(AVG(o_totalprice), 4) AS a"))
pair("aggregate_empty", "orders", "SELECT COUNT(*) AS n, SUM(o_custkey) AS s, MAX(o_orderkey) AS m FROM orders WHERE o_orderkey < 0", f"SELECT COUNT(*) AS n, {R('SUM(o_custkey)')} AS s, MAX(o_orderkey) AS m FROM orders WHERE o_orderkey < 0")
pair("aggregate_distinct", "lineitem", "SELECT COUNT(DISTINCT l_partkey) AS parts, SUM(DISTINCT l_linenumber) AS s, AVG(DISTINCT l_linenumber) AS a, MIN(DISTINCT l_suppkey) AS m FROM lineitem", f"SELECT COUNT(DISTINCT l_partkey) AS parts, {R('SUM(DISTINCT l_linenumber)')} AS s, round(AVG(DISTINCT l_linenumber), 4) AS a, MIN(l_suppkey) AS m FROM lineitem")
pair("aggregate_filter", "orders", "SELECT COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f, SUM(o_totalprice) FILTER (WHERE o_custkey < 100) AS s FROM orders", f"SELECT COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f, {R('SUM(' + D8('o_totalprice') + ') FILTER (WHERE o_custkey < 100)')} AS s FROM orders")
pair("aggregate_expression_input", "lineitem", "SELECT SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS returned, AVG(l_linenumber + 1) AS a FROM lineitem", f"SELECT {R('SUM(CAST(CASE WHEN l_returnflag = ' + chr(39) + 'R' + chr(39) + ' THEN l_quantity ELSE 0 END AS DECIMAL(22,8)))')} AS returned, round(AVG(l_linenumber + 1), 4) AS a FROM lineitem")
pair("global_window_input", "orders", "SELECT SUM(o_custkey) AS s, COUNT(*) AS n FROM orders ORDER BY o_totalprice DESC LIMIT 100 OFFSET 10", f"SELECT {R('SUM(o_custkey)')} AS s, COUNT(*) AS n FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 10)")
pair("global_having", "orders", "SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 100000000")
pair("group_by", "orders", "SELECT o_orderstatus, COUNT(*) AS n, MAX(o_totalprice) AS m FROM orders GROUP BY o_orderstatus")
pair("group_many", "lineitem", "SELECT l_partkey, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem GROUP BY l_partkey", f"SELECT l_partkey, COUNT(*) AS n, {R('SUM(' + D8('l_quantity') + ')')} AS q FROM lineitem GROUP BY l_partkey")
pair("group_having", "orders", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND o_custkey < 5000")
pair("group_post_aggregate", "lineitem", "SELECT l_returnflag, ROUND(SUM(l_quantity) / COUNT(*), 2) AS ratio, CASE WHEN COUNT(*) > 20000 THEN 'many' ELSE 'few' END AS size FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*), 2) AS ratio, CASE WHEN COUNT(*) > 20000 THEN 'many' ELSE 'few' END AS size FROM lineitem GROUP BY l_returnflag")
pair("group_order_prefix", "orders", "SELECT o_orderpriority, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderpriority, o_orderstatus ORDER BY o_orderpriority DESC LIMIT 4", "SELECT o_orderpriority, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderpriority, o_orderstatus ORDER BY o_orderpriority DESC, o_orderstatus LIMIT 4")
pair("group_top_k", "orders", "SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey ORDER BY total DESC LIMIT 10", f"SELECT o_custkey, {R('SUM(' + D8('o_totalprice') + ')')} AS total FROM orders GROUP BY o_custkey ORDER BY SUM({D8('o_totalprice')}) DESC, o_custkey LIMIT 10")
pair("group_top_k_having", "lineitem", "SELECT l_suppkey, SUM(l_quantity) AS q FROM lineitem GROUP BY l_suppkey HAVING SUM(l_quantity) > 100 ORDER BY q DESC LIMIT 16", f"SELECT l_suppkey, {R('SUM(' + D8('l_quantity') + ')')} AS q FROM lineitem GROUP BY l_suppkey HAVING SUM(l_quantity) > 100 ORDER BY SUM({D8('l_quantity')}) DESC, l_suppkey LIMIT 16")
pair("group_distinct_filter", "events", "SELECT event_type, COUNT(DISTINCT user_id) AS users, COUNT(*) FILTER (WHERE value > 50) AS big FROM events GROUP BY event_type")
pair("order_limit_offset", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 10 OFFSET 5", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
pair("order_expression", "customer", "SELECT c_custkey FROM customer ORDER BY LENGTH(c_mktsegment) DESC, LOWER(c_name) LIMIT 10", "SELECT c_custkey FROM customer ORDER BY length(c_mktsegment) DESC, lower(c_name), c_custkey LIMIT 10")
pair("order_case_nulls", "orders", "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders ORDER BY s, o_orderkey LIMIT 20", "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders ORDER BY s NULLS FIRST, o_orderkey LIMIT 20")
pair("functions_numeric", "part", "SELECT p_partkey, ABS(1 - p_size) AS a, CEIL(p_retailprice) AS c, FLOOR(p_retailprice) AS f, ROUND(p_retailprice, 1) AS r, TRUNC(p_retailprice, 1) AS t, SIGN(p_size - 25) AS s, MOD(p_partkey, 7) AS m FROM part", "SELECT p_partkey, CAST(abs(1 - p_size) AS DOUBLE) AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, CAST(round(CAST(p_retailprice AS DECIMAL(18,4)), 1) AS DOUBLE) AS r, CAST(trunc(CAST(p_retailprice AS DECIMAL(18,4)) * 10) / 10 AS DOUBLE) AS t, CAST(sign(p_size - 25) AS DOUBLE) AS s, CAST(p_partkey % 7 AS DOUBLE) AS m FROM part")
pair("functions_log_power", "part", "SELECT p_partkey, ROUND(SQRT(p_size), 4) AS q, ROUND(CBRT(p_size), 4) AS c, ROUND(LN(p_size), 4) AS l, ROUND(LOG2(p_size), 4) AS l2, ROUND(LOG10(p_size), 4) AS l10, ROUND(LOG(3, p_size), 4) AS l3, POWER(p_size, 2) AS p, ROUND(EXP(p_size / 50), 4) AS e FROM part", "SELECT p_partkey, round(sqrt(p_size), 4) AS q, round(cbrt(p_size), 4) AS c, round(ln(p_size), 4) AS l, round(log2(p_size), 4) AS l2, round(log10(p_size), 4) AS l10, round(ln(p_size) / ln(3), 4) AS l3, CAST(p_size * p_size AS DOUBLE) AS p, round(exp(p_size / 50.0), 4) AS e FROM part")
pair("functions_text", "customer", "SELECT c_custkey, LOWER(c_name) AS lo, UPPER(c_mktsegment) AS up, LENGTH(c_name) AS n, OCTET_LENGTH(c_name) AS o, LEFT(c_name, 4) AS l, RIGHT(c_name, 3) AS r, POSITION('#', c_name) AS p, REPLACE(c_name, 'Customer', 'C') AS x, SUBSTRING(c_name, 3, 5) AS s, TRIM(c_name) AS t, LTRIM(c_name) AS lt, RTRIM(c_name) AS rt FROM customer", "SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, length(c_name) AS n, strlen(c_name) AS o, left(c_name, 4) AS l, right(c_name, 3) AS r, position('#' IN c_name) AS p, replace(c_name, 'Customer', 'C') AS x, substring(c_name, 3, 5) AS s, trim(c_name) AS t, ltrim(c_name) AS lt, rtrim(c_name) AS rt FROM customer")
pair("functions_conditional", "orders", "SELECT o_orderkey, COALESCE(NULLIF(o_orderstatus, 'F'), 'none') AS c, CASE WHEN o_totalprice > 100000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' END AS k FROM orders")
pair("arithmetic_division", "lineitem", "SELECT l_orderkey, l_partkey, l_linenumber, ROUND(l_extendedprice / 7, 4) AS unit FROM lineitem", "SELECT l_orderkey, l_partkey, l_linenumber, round(l_extendedprice / 7, 4) AS unit FROM lineitem")
pair("average_wide", "orders", "SELECT o_orderstatus, ROUND(AVG(o_totalprice * 1000000)) AS a, ROUND(SUM(o_totalprice * 1000000) / COUNT(*)) AS q FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(AVG(CAST(CAST(o_totalprice AS DECIMAL(18,4)) * 1000000 AS DOUBLE))) AS a, round(AVG(CAST(CAST(o_totalprice AS DECIMAL(18,4)) * 1000000 AS DOUBLE))) AS q FROM orders GROUP BY o_orderstatus")
pair("division_wide", "lineitem", "SELECT l_orderkey, l_partkey, l_linenumber, ROUND(l_extendedprice * 1000000000 / 8, 2) AS unit FROM lineitem", "SELECT l_orderkey, l_partkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(28,4)) * 1000000000 / 8, 2) AS DOUBLE) AS unit FROM lineitem")
pair("composite_key", "conversations", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn = 0")
pair("composite_min_max_key", "conversations", "SELECT role, MIN(turn) AS lo, MAX(turn) AS hi, COUNT(DISTINCT conv_id) AS c FROM conversations GROUP BY role")


# Queries that start from the fluent API or that change a store.


def fluent_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = database(spark, sf_dir, "orders").query("orders")
    return q.filter(field("o_totalprice").between(1000, 200000) & field("o_orderstatus").in_("F", "O") & ~field("o_orderpriority").starts_with_ci("1-")).select("o_orderkey", "o_custkey").execute()


def fluent_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = database(spark, sf_dir, "part").query("part")
    return shown(q.select("p_partkey", field("p_size").add(3).mul(2).alias("x"), field("p_brand").lower().alias("b"), fn("round", field("p_retailprice"), 1).alias("r")).order_by_desc("p_retailprice").limit(50).execute())


def fluent_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = database(spark, sf_dir, "lineitem").query("lineitem")
    return shown(q.group_by("l_returnflag").aggregate(n=agg("count"), q=agg("sum", "l_quantity"), d=agg("count", "l_suppkey", distinct=True)).having(agg("count") > 0).execute())


def fluent_terminals(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = database(spark, sf_dir, "orders").query("orders").filter(field("o_orderstatus") == "F").order_by_desc("o_totalprice")
    row = (q.execute_exact_count(), q.exists(), q.first(), q.last(), q.terminal(agg("min")), q.terminal(agg("max")))
    return spark.createDataFrame([row], "n long, any boolean, first long, last long, lo long, hi long")


def get_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = database(spark, sf_dir, "customer").query("customer").get_many([5, 3, 5, 10**9])
    return spark.createDataFrame([(i, None if r is None else r.c_custkey, None if r is None else r.c_name) for i, r in enumerate(rows)], "pos int, c_custkey long, c_name string")


def _walk(spark: SparkSession, sf_dir: str, exhaustive: bool) -> DataFrame:
    q = database(spark, sf_dir, "customer").query("customer").select("c_custkey", "c_mktsegment").order_by("c_mktsegment").order_by_desc("c_acctbal").limit(400)
    rows = [(k, i) for k, p in enumerate(q.pages(exhaustive)) for i in p.rows]
    return spark.createDataFrame([(k, r.c_custkey, r.c_mktsegment) for k, r in rows], "page int, c_custkey long, c_mktsegment string")


def live_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir, False)


def exhaustive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk(spark, sf_dir, True)


def grouped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, rows, cursor = database(spark, sf_dir, "nation").query("nation").group_by("n_regionkey").aggregate(n=agg("count")).limit(2), [], None
    while True:
        page = q.execute_grouped(cursor=cursor)
        rows += [(r.n_regionkey, r.n) for r in page.rows]
        if (cursor := page.cursor) is None:
            return spark.createDataFrame(rows, "n_regionkey int, n long")


def _small(spark: SparkSession, sf_dir: str) -> Database:
    """A writable copy of nation and region in a store of its own."""
    db = Database(spark)
    db.create(EntitySchema("Region", (FieldSpec("id", "int32"), FieldSpec("name", "text", max_len=40)), ("id",)))
    db.create(EntitySchema("Nation", (FieldSpec("id", "int32"), FieldSpec("name", "text"), FieldSpec("region", "int32", relation="Region"), FieldSpec("note", "text", True, default="new", has_default=True)), ("id",)))
    db.insert_frame("Region", spark.read.parquet(f"{sf_dir}/region.parquet").toDF("id", "name"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    db.insert_frame("Nation", n.select(n.n_nationkey.alias("id"), n.n_name.alias("name"), n.n_regionkey.alias("region"), F.lit(None).cast("string").alias("note")))
    return db


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _small(spark, sf_dir)
    db.sql("INSERT INTO Region (id, name) VALUES (10, 'ten'), (11, 'eleven')")
    db.sql("INSERT INTO Nation (id, name, region) VALUES (100, 'a', 10), (101, 'b', 10), (102, 'c', 11)")
    db.sql("UPDATE Nation SET note = 'old' WHERE region = 1")
    db.sql("DELETE FROM Nation WHERE id >= 101")
    db.sql("INSERT INTO Nation (id, name, region, note) SELECT id + 200, name, region, note FROM Nation WHERE region = 3")
    return db.sql("SELECT * FROM Nation")


def returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _small(spark, sf_dir).sql("DELETE FROM Nation WHERE region = 2 ORDER BY name LIMIT 3 RETURNING id, name")


def ddl_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _small(spark, sf_dir)
    db.sql("ALTER TABLE Region ADD COLUMN size Int64 DEFAULT 7")
    db.sql("INSERT INTO Region (id, name, size) VALUES (20, 'x', 9)")
    db.sql("ALTER TABLE Region RENAME COLUMN name TO label")
    db.sql("CREATE UNIQUE INDEX by_label ON Region (label)")
    return db.sql("SELECT id, label, size FROM Region")


def integrity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _small(spark, sf_dir).sql("CHECK INTEGRITY DEEP START Nation")


def normalizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    return df.select("p_partkey", Z.lower(df.p_name).alias("lower"), Z.upper(df.p_name).alias("upper"), Z.numeric(df.p_brand).alias("digits"), Z.alphanumeric(df.p_brand).alias("alnum"), Z.clamp(df.p_size, 10, 40).alias("clamped"))


def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    return df.select("p_partkey", V.length_range(df.p_name, 5, 10).alias("len"), V.in_range(df.p_size, 5, 20).alias("rng"), V.multiple_of(df.p_size, 5).alias("mult"), V.in_array(df.p_brand, ["Brand#11", "Brand#12"]).alias("arr"), V.alphanum_uscore(df.p_brand).alias("au"))


OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "fluent_filter": (fluent_filter, "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus IN ('F', 'O') AND NOT starts_with(lower(o_orderpriority), '1-')"),
    "fluent_projection": (fluent_projection, "SELECT p_partkey, CAST((p_size + 3) * 2 AS DOUBLE) AS x, lower(p_brand) AS b, CAST(round(CAST(p_retailprice AS DECIMAL(18,4)), 1) AS DOUBLE) AS r FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50"),
    "fluent_grouped": (fluent_grouped, f"SELECT l_returnflag, COUNT(*) AS n, {R('SUM(' + D8('l_quantity') + ')')} AS q, COUNT(DISTINCT l_suppkey) AS d FROM lineitem GROUP BY l_returnflag"),
    "fluent_terminals": (fluent_terminals, "SELECT COUNT(*) AS n, COUNT(*) > 0 AS any, (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS first, (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey DESC LIMIT 1) AS last, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM orders WHERE o_orderstatus = 'F'"),
    "get_many": (get_many, "SELECT k.pos, c_custkey, c_name FROM (VALUES (0, 5), (1, 3), (2, 5), (3, 1000000000)) k(pos, id) LEFT JOIN customer ON c_custkey = k.id"),
    "live_pages": (live_pages, "SELECT CAST((row_number() OVER w - 1) // 400 AS INTEGER) AS page, c_custkey, c_mktsegment FROM customer WINDOW w AS (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey)"),
    "exhaustive_pages": (exhaustive_pages, "SELECT CAST((row_number() OVER w - 1) // 400 AS INTEGER) AS page, c_custkey, c_mktsegment FROM customer WINDOW w AS (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey)"),
    "grouped_pages": (grouped_pages, "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey"),
    "mutations": (mutations, "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region, CASE WHEN n_regionkey = 1 THEN 'old' END AS note FROM nation UNION ALL SELECT 100, 'a', 10, 'new' UNION ALL SELECT n_nationkey + 200, n_name, n_regionkey, NULL FROM nation WHERE n_regionkey = 3"),
    "returning": (returning, "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 2 ORDER BY n_name, n_nationkey LIMIT 3"),
    "ddl_columns": (ddl_columns, "SELECT r_regionkey AS id, r_name AS label, CAST(7 AS BIGINT) AS size FROM region UNION ALL SELECT 20, 'x', 9"),
    "integrity_check": (integrity_check, "SELECT CAST('' AS VARCHAR) AS problem, CAST(0 AS BIGINT) AS rows FROM region WHERE FALSE"),
    "normalizers": (normalizers, "SELECT p_partkey, lower(p_name) AS lower, upper(p_name) AS upper, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, regexp_replace(p_brand, '[^0-9A-Za-z]', '', 'g') AS alnum, greatest(least(p_size, 40), 10) AS clamped FROM part"),
    "validators": (validators, "SELECT p_partkey, length(p_name) BETWEEN 5 AND 10 AS len, p_size BETWEEN 5 AND 20 AS rng, p_size % 5 = 0 AS mult, p_brand IN ('Brand#11', 'Brand#12') AS arr, regexp_full_match(p_brand, '[A-Za-z0-9_]*') AS au FROM part"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: sql(ours, entity) for name, (entity, ours, _) in PAIRS.items()} | {name: f for name, (f, _) in OTHERS.items()} | coverage.queries()


def oracle_sql() -> dict[str, str]:
    return {name: theirs for name, (_, _, theirs) in PAIRS.items()} | {name: text for name, (_, text) in OTHERS.items() if text} | coverage.oracle_sql()
