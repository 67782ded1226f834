"""Registered queries of nested and collection fields, refusals, writes, DDL, SHOW, jobs and value functions.

Refusals are tables of statements and the codes that the engine gives; their twins state the codes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import normalizers as Z
from quillon.functions import validators as V
from quillon.functions.errors import QueryError
from quillon.functions.schema import CheckSpec, EntitySchema, FieldSpec, IndexSpec, of_table
from quillon.operators.database import Database
from quillon.operators.fluent import agg, false, field, fn, true
from quillon.plans.admission import PUBLIC, GroupLimits, ReadIntent
from quillon.streaming.jobs import MutationJob, ResumableJob

Query = Callable[[SparkSession, str], DataFrame]
MADE: dict[str, tuple[Query, str]] = {}

#: customer as an entity with nulls, empty texts, a list and a record; the same in DuckDB's words.
USERS = [
    "c_custkey AS id", "CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN '' ELSE c_name END AS name", "CAST(CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 80 END AS INT) AS age",
    "CAST(c_nationkey AS INT) AS rank", "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 2 = 0 END AS ok",
]
SPARK_ONLY = ["CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN CAST(array() AS array<string>) ELSE array(c_mktsegment, c_name) END AS tags", "named_struct('city', concat('c', c_nationkey), 'zip', CAST(c_custkey % 100 AS INT)) AS place"]
BASE = "(SELECT " + ", ".join(USERS) + ", CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE [c_mktsegment, c_name] END AS tags, 'c' || c_nationkey AS city, CAST(c_custkey % 100 AS INT) AS zip FROM customer) u"


def users(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(spark, secret=b"k" * 32)
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(*USERS, *SPARK_ONLY)
    db.register(of_table("users", df.schema, ("id",), (IndexSpec("by_rank", ("rank", "id")),)), df)
    return db


def made(name: str, twin: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        MADE[name] = f, twin
        return f

    return keep


def statement(name: str, ours: str, twin: str) -> None:
    MADE[name] = (lambda spark, sf_dir: users(spark, sf_dir).sql(ours, max_groups=None)), twin


def rows_sql(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


def code_of(f: Callable[[], object]) -> str:
    try:
        f()
    except QueryError as e:
        return e.code
    return "accepted"


def refused(name: str, cases: list[tuple[str, str]], make: Callable[[SparkSession, str], Database] = users, **how: object) -> None:
    """A query of (statement, code) rows for statements and the codes they must get."""
    MADE[name] = (lambda spark, sf_dir: (lambda db: spark.createDataFrame([(t, code_of(lambda t=t: db.sql(t, **how))) for t, _ in cases], "statement string, code string"))(make(spark, sf_dir))), rows_sql(cases, "statement, code")


statement("nested_path", "SELECT id, place.city AS city FROM users WHERE place.zip < 10 AND place.city <> 'c3'", f"SELECT id, city FROM {BASE} WHERE zip < 10 AND city <> 'c3'")
statement("is_empty_text", "SELECT id FROM users WHERE name IS EMPTY", f"SELECT id FROM {BASE} WHERE name = ''")
statement("is_not_empty_list", "SELECT id FROM users WHERE tags IS NOT EMPTY", f"SELECT id FROM {BASE} WHERE len(tags) > 0")
statement("is_missing", "SELECT id FROM users WHERE name IS MISSING OR age IS NULL", f"SELECT id FROM {BASE} WHERE age IS NULL")
statement("covering_index", "SELECT rank, id FROM users WHERE rank = 5", f"SELECT rank, id FROM {BASE} WHERE rank = 5")
statement("order_scalar_kinds", "SELECT id, age FROM users ORDER BY ok, age + 1 DESC, name LIMIT 25", f"SELECT id, age FROM {BASE} ORDER BY ok NULLS FIRST, age DESC NULLS LAST, name NULLS FIRST, id LIMIT 25")
statement("global_order_by_output", "SELECT COUNT(*) AS n, MAX(rank) AS m FROM users ORDER BY n", f"SELECT COUNT(*) AS n, MAX(rank) AS m FROM {BASE}")
statement("distinct_with_group", "SELECT DISTINCT rank, COUNT(*) AS n FROM users GROUP BY rank", f"SELECT DISTINCT rank, COUNT(*) AS n FROM {BASE} GROUP BY rank")
statement("ilike_prefix", "SELECT id FROM users WHERE name ILIKE 'cUST%' AND name NOT LIKE 'Customer#00000000%'", f"SELECT id FROM {BASE} WHERE name ILIKE 'cUST%' AND name NOT LIKE 'Customer#00000000%'")
statement("is_not_true", "SELECT id FROM users WHERE ok IS NOT TRUE", f"SELECT id FROM {BASE} WHERE NOT ok")
statement("aggregates_of_nulls", "SELECT rank, COUNT(age) AS c, MIN(age) AS lo, MAX(name) AS hi, COUNT(DISTINCT ok) AS d FROM users GROUP BY rank", f"SELECT rank, COUNT(age) AS c, MIN(age) AS lo, MAX(name) AS hi, COUNT(DISTINCT ok) AS d FROM {BASE} GROUP BY rank")


def fluent(name: str, f: Callable, twin: str) -> None:
    MADE[name] = (lambda spark, sf_dir: f(users(spark, sf_dir).query("users"))), twin


fluent("collection_contains", lambda q: q.filter(field("tags").contains_item("BUILDING")).select("id").execute(), f"SELECT id FROM {BASE} WHERE list_contains(tags, 'BUILDING')")
fluent("text_ci", lambda q: q.filter(field("name").contains_ci("STOMER#") & field("name").starts_with_ci("cust") & ~field("name").ends_with_ci("7")).select("id").execute(), f"SELECT id FROM {BASE} WHERE contains(lower(name), 'stomer#') AND starts_with(lower(name), 'cust') AND NOT ends_with(lower(name), '7')")
fluent("equal_ci", lambda q: q.filter(field("name").eq_ci("CUSTOMER#000000004")).select("id").execute(), f"SELECT id FROM {BASE} WHERE lower(name) = 'customer#000000004'")
fluent("between_fields", lambda q: q.filter(field("age").between_fields("rank", "id") | field("age").not_between_fields("rank", "id")).filter(field("rank").gt_field("age")).select("id").execute(), f"SELECT id FROM {BASE} WHERE age IS NOT NULL AND rank > age")
fluent("true_false", lambda q: q.filter(true() & ~false() & (field("rank") >= 20)).select("id").execute(), f"SELECT id FROM {BASE} WHERE rank >= 20")
fluent("builder_text", lambda q: q.select("id", field("name").trim().alias("t"), field("name").ltrim().alias("lt"), field("name").rtrim().alias("rt"), field("name").upper().alias("u"), field("name").length().alias("n"), field("name").left(3).alias("l"), field("name").right(2).alias("r"), field("name").replace("mer", "-").alias("x"), field("name").substring(2, 3).alias("s"), field("name").position("#").alias("p")).execute(), f"SELECT id, trim(name) AS t, ltrim(name) AS lt, rtrim(name) AS rt, upper(name) AS u, length(name) AS n, left(name, 3) AS l, right(name, 2) AS r, replace(name, 'mer', '-') AS x, substring(name, 2, 3) AS s, position('#' IN name) AS p FROM {BASE}")
fluent("builder_numeric", lambda q: q.select("id", field("rank").add(2).alias("a"), field("rank").sub(3).alias("b"), field("rank").mul(4).alias("c"), fn("round", field("rank").div(4), 1).alias("d")).execute().selectExpr("id", "cast(a as double) a", "cast(b as double) b", "cast(c as double) c", "cast(d as double) d"), f"SELECT id, CAST(rank + 2 AS DOUBLE) AS a, CAST(rank - 3 AS DOUBLE) AS b, CAST(rank * 4 AS DOUBLE) AS c, CAST(round(CAST(rank AS DECIMAL(18,4)) / 4 + 0.0000001, 1) AS DOUBLE) AS d FROM {BASE}")
fluent("global_distinct_aggregate", lambda q: q.group_by().aggregate(n=agg("count", "rank", distinct=True)).execute(), f"SELECT COUNT(DISTINCT rank) AS n FROM {BASE}")
fluent("terminal_no_input", lambda q: q.group_by("rank").aggregate(lo=agg("min"), hi=agg("max")).execute(), f"SELECT rank, MIN(id) AS lo, MAX(id) AS hi FROM {BASE} GROUP BY rank")
fluent("complete_small_set", lambda q: q.db.spark.createDataFrame([(r.id,) for r in q.filter(field("id") <= 20).select("id").execute_complete_small_set(30)], "id long"), f"SELECT id FROM {BASE} WHERE id <= 20")

refused("refused_window", [("SELECT COUNT(*) OVER () FROM users", "unsupported"), ("SELECT SUM(rank) OVER (PARTITION BY age) FROM users", "unsupported")])
refused("refused_set_operations", [(f"SELECT id FROM users {x} SELECT id FROM users", "unsupported") for x in ("UNION", "INTERSECT", "EXCEPT")])
refused("refused_subqueries", [("SELECT id FROM users WHERE id IN (SELECT 1)", "unsupported"), ("WITH x AS (SELECT 1) SELECT 1", "unsupported"), ("SELECT id FROM (SELECT 1)", "syntax")])
refused("refused_joins", [("SELECT * FROM a JOIN b", "unsupported"), ("SELECT * FROM a, b", "unsupported")])
refused("refused_cast", [("SELECT CAST(id AS TEXT) FROM users", "unsupported")])
refused("refused_transactions", [(x, "unsupported") for x in ("BEGIN", "COMMIT", "ROLLBACK")])
refused("refused_simple_case", [("SELECT CASE id WHEN 1 THEN 2 END FROM users", "unsupported")])
refused("refused_parameters", [("SELECT id FROM users WHERE id = ?", "parameter")])
refused("refused_quoted_identifiers", [('SELECT "id" FROM users', "quoted_identifier")])
refused("refused_names", [("SELECT foo(id) FROM users", "unknown_function"), ("SELECT id FROM nowhere", "unknown_entity"), ("SELECT nope FROM users", "unknown_field")])
refused("refused_literal_projection", [("SELECT 1 FROM users", "literal_projection")])
refused("refused_types", [("SELECT id FROM users WHERE name = 1", "type_mismatch"), ("SELECT id FROM users WHERE name > tags", "type_mismatch"), ("SELECT MIN(tags) FROM users", "type_mismatch"), ("SELECT id FROM users ORDER BY tags", "unordered")])
refused("refused_like_patterns", [(f"SELECT id FROM users WHERE name LIKE '{x}'", "like_pattern") for x in ("%x", "a%b", "a_")])
refused("refused_aggregate_nesting", [("SELECT SUM(COUNT(*)) FROM users", "nested_aggregate"), ("SELECT COUNT(DISTINCT id) FILTER (WHERE ok) FROM users", "distinct_filter")])
refused("refused_global_having", [("SELECT COUNT(*) FROM users HAVING rank > 1", "ungrouped_field"), ("SELECT id FROM users HAVING id > 1", "having_without_group"), ("SELECT DISTINCT COUNT(*) FROM users", "distinct_aggregate")])
refused("refused_grouped_projection", [("SELECT COUNT(*), rank FROM users GROUP BY rank", "grouped_projection_order"), ("SELECT rank FROM users GROUP BY rank", "empty_aggregates"), ("SELECT * FROM users GROUP BY rank", "grouped_star"), ("SELECT rank, COUNT(*) FROM users GROUP BY rank, rank", "duplicate_group_field"), ("SELECT id, COUNT(*) FROM users GROUP BY rank", "ungrouped_field")])
refused("refused_grouped_order", [("SELECT rank, COUNT(*) AS n FROM users GROUP BY rank ORDER BY n", "grouped_order_limit"), ("SELECT rank, age, COUNT(*) FROM users GROUP BY rank, age ORDER BY age", "grouped_order_prefix")])
refused("refused_order", [("SELECT id FROM users ORDER BY age, age", "duplicate_order"), ("SELECT DISTINCT rank FROM users ORDER BY age", "distinct_order"), ("SELECT id FROM users LIMIT 1 ORDER BY id", "syntax")])
refused("refused_scale", [("SELECT ROUND(rank, -1) FROM users", "scale"), ("SELECT TRUNC(rank, -2) FROM users", "scale")])
refused("refused_outputs", [("SELECT CONTAINS(name, 'x') FROM users", "condition_projection"), ("SELECT id, id FROM users", "duplicate_output")])
refused("refused_writes_of_tables", [("DELETE FROM users WHERE id = 1", "read_only"), ("UPDATE users SET rank = 1", "read_only"), ("EXPLAIN INSERT INTO users VALUES (1)", "syntax")])
refused("refused_group_budget", [("SELECT id, COUNT(*) FROM users GROUP BY id", "group_budget")], max_groups=3)
refused("admission_public", [("SELECT id FROM users", "full_scan"), ("SELECT id FROM users WHERE rank = 5", "limit_required"), ("SELECT id FROM users WHERE rank = 5 LIMIT 500", "row_bound"), ("SELECT id FROM users WHERE rank = 5 ORDER BY age LIMIT 5", "materialized_sort"), ("SELECT rank, COUNT(*) FROM users GROUP BY rank", "grouped_budget_required"), ("SELECT id FROM users WHERE rank = 5 ORDER BY id LIMIT 5", "accepted"), ("SELECT id FROM users WHERE id = 5", "accepted")], policy=PUBLIC)


@made("read_intents", rows_sql([(x.value,) for x in ReadIntent], "intent"))
def read_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An intent grants nothing: the same rows come back under each."""
    q = users(spark, sf_dir).query("users").filter(field("id") == 1).select("id")
    return spark.createDataFrame([(x.value,) for x in ReadIntent if [r.id for r in q.intended(x).execute().collect()] == [1]], "intent string")


@made("cursor_refusals", rows_sql([("another plan", "cursor_plan"), ("forged", "cursor_invalid"), ("offset", "cursor_offset"), ("limits", "group_budget"), ("bytes", "group_bytes")], "what, code"))
def cursor_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = users(spark, sf_dir)
    q = db.query("users").select("id", "age").order_by_desc("age").limit(2)
    token, g = q.execute_live_page().cursor, db.query("users").group_by("rank").aggregate(n=agg("count"))
    cases = [("another plan", lambda: db.query("users").order_by("rank").limit(2).execute_live_page(token)), ("forged", lambda: q.execute_live_page(token[:-6] + "AAAA==")), ("offset", lambda: q.offset(1).execute_live_page()), ("limits", lambda: g.execute_grouped(GroupLimits(1))), ("bytes", lambda: g.execute_grouped(GroupLimits(100, 2)))]
    return spark.createDataFrame([(what, code_of(f)) for what, f in cases], "what string, code string")


@made("plan_fingerprint", rows_sql([(1,)], "plans"))
def plan_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that mean the same have one fingerprint."""
    from quillon.plans.select import fingerprint
    from quillon.plans.sqltext import parse

    schema = users(spark, sf_dir).schema("users")
    same = {fingerprint(parse(f"SELECT id FROM users WHERE {w}"), schema) for w in ("id = 1 AND rank = 2", "2 = rank AND id = 1", "NOT NOT (id = 1 AND rank = 2)")}
    return spark.createDataFrame([(len(same),)], "plans int")


@made("explain", rows_sql([("by key", True), ("full scan", True), ("json", True)], "what, ok"))
def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = users(spark, sf_dir)
    text = lambda s: db.sql(s).first().plan
    found = [("by key", "full_scan" not in text("EXPLAIN SELECT id FROM users WHERE id = 1")), ("full scan", "full_scan" in text("EXPLAIN SELECT id FROM users WHERE age = 1")), ("json", text("EXPLAIN JSON SELECT id FROM users WHERE id = 1").startswith("{"))]
    return spark.createDataFrame(found, "what string, ok boolean")


# writes, over copies of nation and region in a store of their own


def league(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(spark)
    db.create(EntitySchema("Team", (FieldSpec("id", "int32"), FieldSpec("name", "text", max_len=20)), ("id",), (IndexSpec("u", ("LOWER(name)",), True),)))
    fields = (FieldSpec("id", "nat64", generated="identity"), FieldSpec("team", "int32", True, relation="Team"), FieldSpec("level", "nat8", default=1, has_default=True), FieldSpec("made", "timestamp", generated="created_at"), FieldSpec("changed", "timestamp", generated="updated_at"))
    db.create(EntitySchema("Player", fields, ("id",), checks=(CheckSpec("cap", "level <= 200"),)))
    db.insert_frame("Team", spark.read.parquet(f"{sf_dir}/region.parquet").selectExpr("cast(r_regionkey as int) id", "r_name name"))
    return db


@made("insert_defaults", rows_sql([(1, 1), (2, 7), (3, 1)], "id, level"))
def insert_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = league(spark, sf_dir)
    db.sql("INSERT INTO Player DEFAULT VALUES")
    db.sql("INSERT INTO Player (team, level) VALUES (1, 7), (2, DEFAULT)")
    return db.sql("SELECT id, level FROM Player").selectExpr("cast(id as int) id", "cast(level as int) level")


@made("managed_fields", "SELECT COUNT(*) AS n FROM region")
def managed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities, creation and change times, and ULIDs of INSERT SELECT: rows where all are as they must be."""
    db = league(spark, sf_dir)
    db.create(EntitySchema("Tagged", (FieldSpec("id", "ulid", generated="ulid"), FieldSpec("name", "text"), FieldSpec("made", "timestamp", generated="created_at")), ("id",)))
    db.sql("INSERT INTO Tagged (name) SELECT name FROM Team")
    return db.rows("Tagged").filter("length(id) = 26 and id rlike '^[0-9A-HJKMNP-TV-Z]+$' and made is not null").agg(F.count_distinct("id").alias("n"))


refused("refused_inserts", [("INSERT INTO Player (team) VALUES (9)", "relation"), ("INSERT INTO Player (level) VALUES (201)", "constraint"), ("INSERT INTO Player (level) VALUES (300)", "constraint"), ("INSERT INTO Team VALUES (9, 'a name that is too long')", "constraint"), ("INSERT INTO Team VALUES (9, 'asia')", "unique"), ("INSERT INTO Team VALUES (1, 'x')", "unique"), ("INSERT INTO Team (id) VALUES (9)", "missing_value"), ("INSERT INTO Team VALUES (9)", "insert_width"), ("INSERT INTO Team VALUES ('x', 'y')", "type_mismatch")], league)
refused("refused_updates", [("UPDATE Team SET id = 1", "key_update"), ("UPDATE Team SET name = 'asia'", "unique"), ("UPDATE Team SET name = 'b' LIMIT 101", "update_limit")], league)


@made("relation_blocks_delete", rows_sql([("delete of a target", "relation"), ("delete of another", "accepted")], "what, code"))
def relation_blocks_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = league(spark, sf_dir)
    db.sql("INSERT INTO Player (team) VALUES (1)")
    return spark.createDataFrame([("delete of a target", code_of(lambda: db.sql("DELETE FROM Team WHERE id = 1"))), ("delete of another", code_of(lambda: db.sql("DELETE FROM Team WHERE id = 2")))], "what string, code string")


@made("structural_writes", "SELECT CAST(r_regionkey AS INT) AS id, CASE WHEN r_regionkey = 2 THEN 'teal' ELSE r_name END AS name FROM region WHERE r_regionkey <> 3 UNION ALL SELECT 60, 'new' UNION ALL SELECT 70, 'batch'")
def structural_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = league(spark, sf_dir)
    db.batch({"Player": [{"team": 70}], "Team": [{"id": 70, "name": "batch"}]})
    db.replace_row("Team", {"id": 2, "name": "teal"})
    db.insert_rows("Team", [{"id": 60, "name": "old"}])
    db.update_row("Team", {"id": 60}, {"name": "new"})
    db.delete_row("Team", {"id": 3})
    return db.sql("SELECT id, name FROM Team")


@made("ddl_lifecycle", "SELECT CAST(r_regionkey AS INT) AS id, CAST(8 AS BIGINT) AS seats FROM region WHERE FALSE UNION ALL SELECT CAST(r_regionkey AS INT), 3 FROM region UNION ALL SELECT 90, 8")
def ddl_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = league(spark, sf_dir)
    for text in ("ADD COLUMN size Int64 DEFAULT 3", "ALTER COLUMN size SET DEFAULT 8", "RENAME COLUMN size TO seats", "ADD CONSTRAINT few CHECK (seats < 5) NOT VALID", "DROP CONSTRAINT few", "ADD CONSTRAINT some CHECK (seats < 50)"):
        db.sql(f"ALTER TABLE Team {text}")
    db.sql("CREATE INDEX IF NOT EXISTS s ON Team (seats)")
    db.sql("DROP INDEX s")
    db.sql("DROP INDEX IF EXISTS s")
    db.sql("INSERT INTO Team (id, name) VALUES (90, 'd')")
    return db.sql("SELECT id, seats FROM Team")


refused("refused_ddl", [("ALTER TABLE Team DROP COLUMN name", "field_in_use"), ("ALTER TABLE Team RENAME COLUMN name TO n", "field_in_use"), ("ALTER TABLE Team ADD CONSTRAINT few CHECK (id < 2)", "constraint"), ("DROP INDEX u ON Team", "index_owner")], league)


@made("show", rows_sql([("columns", "id", "int32"), ("columns", "name", "text"), ("constraints", "cap", "CHECK"), ("constraints", "primary key", "PRIMARY KEY"), ("entities", "Player", "journaled"), ("entities", "Team", "journaled"), ("indexes", "u", "LOWER(name)"), ("relations", "team", "Team"), ("stores", "heap", ""), ("stores", "journaled", "")], "what, name, value"))
def show(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = league(spark, sf_dir)
    parts = [("columns", "DESCRIBE Team", "name", "kind"), ("constraints", "SHOW CONSTRAINTS Player", "name", "kind"), ("entities", "SHOW ENTITIES", "entity", "store"), ("indexes", "SHOW INDEXES Team", "name", "keys"), ("relations", "SHOW RELATIONS Player", "field", "target"), ("stores", "SHOW STORES", "store", None)]
    rows = [(what, r[a], r[b] if b else "") for what, text, a, b in parts for r in db.sql(text).collect()]
    return spark.createDataFrame(rows, "what string, name string, value string")


@made("integrity_of_bad_rows", rows_sql([("primary key twice", 2), ("name is null", 1)], "problem, rows"))
def integrity_of_bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registered table with a repeated key and a null where none may be."""
    db = Database(spark)
    df = spark.read.parquet(f"{sf_dir}/region.parquet").selectExpr("cast(r_regionkey as int) id", "r_name name").unionByName(spark.createDataFrame([(0, "again"), (77, None)], "id int, name string"))
    db.register(EntitySchema("Bad", (FieldSpec("id", "int32"), FieldSpec("name", "text")), ("id",)), df)
    return db.sql("CHECK INTEGRITY QUICK Bad").selectExpr("problem", "cast(rows as int) rows")


@made("resumable_job", rows_sql([(2, 5, "job_conflict")], "first, last, stale"))
def resumable_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = ResumableJob(league(spark, sf_dir), "count")
    step = lambda n: ((n or 0) + 1, (n or 0) == 4)
    return spark.createDataFrame([(job.run(step, most=2), job.run(step), code_of(lambda: job.advance(1, {})))], "first int, last int, stale string")


@made("mutation_job", rows_sql([("forward", 300, 300)], "phase, updated, rows"))
def mutation_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = league(spark, sf_dir)
    db.insert_rows("Player", [{"level": 3} for _ in range(300)])
    text = "UPDATE Player SET level = 4 WHERE level = 3"
    phase = MutationJob(db, "lift", text).run(1)["phase"]
    done = MutationJob(db, "lift", text).run()["updated"]
    return spark.createDataFrame([(phase, done, db.rows("Player").filter("level = 4").count())], "phase string, updated int, rows int")


@made("migration", "SELECT CAST(r_regionkey AS INT) AS id, upper(r_name) AS label, CAST(length(r_name) + 1 AS BIGINT) AS size FROM region")
def migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators.migrate import Migration

    db = league(spark, sf_dir)
    fields = db.schema("Team").fields
    db.store.commit(db.schema("Team").changed(indexes=()), db.snapshot("Team").number + 1, db.snapshot("Team").files)
    db.migrate("Team", [Migration(2, (fields[0], FieldSpec("label", "text"), FieldSpec("size", "int64")), {"size": "LENGTH(name) + 1", "label": "UPPER(name)"})])
    return db.rows("Team").select("id", "label", "size")


# value functions, case by case: the twin states the results

NORMALIZED = [("kebab", "FooBar baz", "foo-bar-baz"), ("snake", "fooBarBAZQux", "foo_bar_baz_qux"), ("title", "foo_bar", "Foo Bar"), ("upper_camel", "foo bar", "FooBar"), ("upper_snake", "fooBar", "FOO_BAR"), ("trim", " x ", "x"), ("rgb_hex", "#a1b2c3", "A1B2C3"), ("rgb_hex", "zz", "FFFFFF"), ("rgba_hex", "a1b2c3", "A1B2C3FF"), ("mime_type", " Text/HTML ", "text/html"), ("url", "example.com/a", "https://example.com/a"), ("e164", " 123 ", "+123"), ("iso_country", " de ", "DE"), ("iso_language", " EN ", "en"), ("numeric", "a1b2", "12"), ("alphanumeric", "a-1_b", "a1b")]
VALIDATED = [("snake", "foo_bar", True), ("snake", "fooBar", False), ("camel", "fooBar", True), ("title", "Foo Bar", True), ("sentence", "Foo bar", True), ("upper_kebab", "FOO-BAR", True), ("upper_snake", "FOO_BAR", True), ("upper_camel", "FooBar", True), ("kebab", "foo-bar", True), ("alpha_uscore", "ab_c", True), ("alpha_uscore", "ab1", False), ("ascii_only", "abc", True), ("ascii_only", "é", False), ("rgb_hex", "#a1b2c3", False), ("rgb_hex", "a1b2c3", True), ("rgba_hex", "a1b2c3ff", True), ("mime_type", "a/b+c", True), ("mime_type", "a/b/c", False), ("url", "https://a-b.com:8/x?y", True), ("url", "https://-a.com", False), ("e164", "+1234567", True), ("e164", "+0123456", False), ("iso_language", "en", True), ("iso_language", "xx", False), ("sha256_hex", "a" * 64, True), ("sha256_hex", "a", False)]


def _cases(name: str, module: object, cases: list[tuple], kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.createDataFrame([c[:2] for c in cases], "name string, value string")
        result = F.coalesce(*[F.when(F.col("name") == n, getattr(module, n)(F.col("value"))) for n in dict.fromkeys(c[0] for c in cases)])
        return df.withColumn("result", result)

    MADE[name] = run, rows_sql(cases, "name, value, result")


_cases("normalizer_cases", Z, NORMALIZED, "string")
_cases("validator_cases", V, VALIDATED, "boolean")


@made("validator_numbers", "SELECT p_partkey, p_size < 20 AS lt, p_size > 20 AS gt, p_size <= 20 AS lte, p_size >= 20 AS gte, p_size = 20 AS eq, p_size <> 20 AS ne, length(p_name) = 10 AS len_eq, length(p_name) >= 10 AS len_min, length(p_name) <= 10 AS len_max, round(p_retailprice, 1) AS r FROM part")
def validator_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    return df.select("p_partkey", V.lt(df.p_size, 20).alias("lt"), V.gt(df.p_size, 20).alias("gt"), V.lte(df.p_size, 20).alias("lte"), V.gte(df.p_size, 20).alias("gte"), V.equal(df.p_size, 20).alias("eq"), V.not_equal(df.p_size, 20).alias("ne"), V.length_equal(df.p_name, 10).alias("len_eq"), V.length_min(df.p_name, 10).alias("len_min"), V.length_max(df.p_name, 10).alias("len_max"), Z.round_decimal_places(df.p_retailprice, 1).alias("r"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in MADE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: twin for name, (_, twin) in MADE.items()}
