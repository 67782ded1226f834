"""SQL and fluent reads against DuckDB and against stated semantics; refusals by code."""

import random
from decimal import Decimal

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions.errors import QueryError
from quillon.functions.schema import EntitySchema, FieldSpec, IndexSpec
from quillon.operators.database import Database
from quillon.operators.fluent import agg, field
from quillon.plans.admission import PUBLIC
from quillon.plans.sqltext import parse

ROWS = [(1, "Ann", 30, 5, True, ["a"], Decimal("1.50"), 0.1), (2, "bob", None, 7, False, [], Decimal("-2.25"), 0.2), (3, None, 41, 5, None, None, None, None), (4, "  \tzed\n", 2**31 - 1, -3, True, ["b", "c"], Decimal("2.50"), 1e-3), (5, "", -(2**31), 0, False, ["a"], Decimal("0.00"), 1005e-3)]


@pytest.fixture(scope="module")
def db(spark):
    fields = (FieldSpec("id", "int32"), FieldSpec("name", "text", True), FieldSpec("age", "int32", True), FieldSpec("rank", "int32"), FieldSpec("ok", "bool", True), FieldSpec("tags", "list", True, of=(FieldSpec("e", "text"),)), FieldSpec("amount", "decimal", True, scale=2), FieldSpec("f", "float64", True))
    schema = EntitySchema("Users", fields, ("id",), (IndexSpec("by_rank", ("rank", "id")),))
    out = Database(spark, secret=b"k" * 32)
    out.register(schema, spark.createDataFrame(ROWS, schema.spark()))
    return out


def values(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("SELECT id FROM users ORDER BY age LIMIT 2", [(3 - 1,), (5,)]),  # null first, then the least
        ("SELECT id FROM users ORDER BY age DESC LIMIT 5", [(4,), (3,), (1,), (5,), (2,)]),
        ("SELECT id FROM users WHERE NOT (age > 30) ORDER BY id", [(1,), (5,)]),
        ("SELECT id FROM users WHERE ok IS NOT TRUE ORDER BY id", [(2,), (5,)]),
        ("SELECT id FROM users WHERE age IN (30, NULL) ORDER BY id", [(1,)]),
        ("SELECT id FROM users WHERE age NOT IN (30, NULL)", []),
        ("SELECT id FROM users WHERE name IS EMPTY", [(5,)]),
        ("SELECT id FROM users WHERE tags IS NOT EMPTY ORDER BY id", [(1,), (4,), (5,)]),
        ("SELECT id FROM users WHERE name IS MISSING", []),
        ("SELECT TRIM(name) AS t FROM users WHERE id = 4", [("zed",)]),
        ("SELECT id FROM users WHERE name ILIKE 'an%'", [(1,)]),
        ("SELECT 7 / 2 * 1 AS x FROM users WHERE id = 1", [(Decimal("3.5"),)]),
        ("SELECT rank / 3 AS x FROM users WHERE id = 1", [(Decimal("1.666666666666666667"),)]),
        ("SELECT MOD(-7, 3) AS x, ROUND(2.5) AS r, ROUND(-2.5) AS s, TRUNC(-1.29, 1) AS t FROM users WHERE id = 1", [(Decimal(-1), Decimal(3), Decimal(-3), Decimal("-1.2"))]),
        ("SELECT ROUND(f, 2) AS x FROM users WHERE id = 5", [(Decimal("1.01"),)]),
        ("SELECT SUBSTRING(name, 0, 2) AS a, SUBSTRING(name, 2) AS b, LEFT(name, -1) AS c FROM users WHERE id = 1", [("", "nn", "")]),
        ("SELECT NULLIF(rank, 5) AS x, COALESCE(age, rank) AS y FROM users WHERE id = 3", [(None, 41)]),
        ("SELECT SUM(rank) AS s, COUNT(age) AS c, AVG(rank) AS a FROM users", [(Decimal(14), 4, Decimal("2.8"))]),
        ("SELECT SUM(rank) AS s FROM users ORDER BY id LIMIT 2", [(Decimal(12),)]),  # the window is of the input
        ("SELECT COUNT(*) AS n FROM users HAVING COUNT(*) > 9", []),
        ("SELECT rank, COUNT(*) AS n FROM users GROUP BY rank ORDER BY n DESC LIMIT 2", [(5, 2), (-3, 1)]),
        ("SELECT DISTINCT rank, COUNT(*) AS n FROM users GROUP BY rank HAVING COUNT(*) > 1", [(5, 2)]),
        ("SELECT DISTINCT rank FROM users ORDER BY rank DESC LIMIT 2", [(7,), (5,)]),
        ("SELECT COUNT(*) FILTER (WHERE age > 30) AS n FROM users", [(2,)]),
        ("SELECT id FROM users WHERE CASE WHEN rank = 5 THEN ok ELSE id = 2 END ORDER BY id", [(1,), (2,)]),
        ("SELECT u.id FROM users u WHERE u.rank + 1 < 2 ORDER BY id", [(4,), (5,)]),
        ("SELECT LENGTH('é') AS a, OCTET_LENGTH('é') AS b, POSITION('b', 'abc') AS c FROM users WHERE id = 1", [(1, 2, 2)]),
    ],
)
def test_sql(db, text, expected):
    got = values(db.sql(text))
    assert [tuple(Decimal(v).normalize() if isinstance(v, Decimal) else v for v in r) for r in got] == [tuple(Decimal(v).normalize() if isinstance(v, Decimal) else v for v in r) for r in expected]


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("SELECT * FROM a JOIN b", "unsupported"), ("SELECT * FROM a, b", "unsupported"), ("SELECT id FROM users UNION SELECT id FROM users", "unsupported"),
        ("SELECT id FROM (SELECT 1)", "syntax"), ("WITH x AS (SELECT 1) SELECT 1", "unsupported"), ("SELECT CAST(id AS TEXT) FROM users", "unsupported"),
        ("SELECT COUNT(*) OVER () FROM users", "unsupported"), ("BEGIN", "unsupported"), ("SELECT CASE id WHEN 1 THEN 2 END FROM users", "unsupported"),
        ("SELECT id FROM users WHERE id = ?", "parameter"), ('SELECT "id" FROM users', "quoted_identifier"), ("SELECT foo(id) FROM users", "unknown_function"),
        ("SELECT 1 FROM users", "literal_projection"), ("SELECT id FROM users WHERE name LIKE '%x'", "like_pattern"), ("SELECT SUM(COUNT(*)) FROM users", "nested_aggregate"),
        ("SELECT COUNT(DISTINCT id) FILTER (WHERE ok) FROM users", "distinct_filter"), ("SELECT id FROM users LIMIT 1 ORDER BY id", "syntax"), ("SELECT id FROM users WHERE id IN ()", "syntax"),
        ("SELECT id FROM users WHERE id IN (SELECT 1)", "unsupported"), ("SELECT id FROM nowhere", "unknown_entity"), ("SELECT nope FROM users", "unknown_field"),
        ("SELECT id FROM users WHERE name = 1", "type_mismatch"), ("SELECT id FROM users WHERE name > tags", "type_mismatch"), ("SELECT id FROM users HAVING id > 1", "having_without_group"),
        ("SELECT DISTINCT COUNT(*) FROM users", "distinct_aggregate"), ("SELECT rank, COUNT(*) AS n FROM users GROUP BY rank ORDER BY n", "grouped_order_limit"),
        ("SELECT rank, age, COUNT(*) FROM users GROUP BY rank, age ORDER BY age", "grouped_order_prefix"), ("SELECT COUNT(*), rank FROM users GROUP BY rank", "grouped_projection_order"),
        ("SELECT rank FROM users GROUP BY rank", "empty_aggregates"), ("SELECT * FROM users GROUP BY rank", "grouped_star"), ("SELECT rank, COUNT(*) FROM users GROUP BY rank, rank", "duplicate_group_field"),
        ("SELECT id, COUNT(*) FROM users GROUP BY rank", "ungrouped_field"), ("SELECT COUNT(*) FROM users HAVING rank > 1", "ungrouped_field"), ("SELECT id FROM users ORDER BY age, age", "duplicate_order"),
        ("SELECT DISTINCT rank FROM users ORDER BY age", "distinct_order"), ("SELECT id FROM users ORDER BY tags", "unordered"), ("SELECT ROUND(rank, -1) FROM users", "scale"),
        ("SELECT CONTAINS(name, 'x') FROM users", "condition_projection"), ("SELECT id, id FROM users", "duplicate_output"), ("SELECT id FROM users WHERE id = 1 id", "syntax"),
        ("DELETE FROM users WHERE id = 1", "read_only"), ("EXPLAIN INSERT INTO users VALUES (1)", "syntax"), ("SELECT MIN(tags) FROM users", "type_mismatch"),
    ],
)
def test_refusals(db, text, code):
    with pytest.raises(QueryError) as e:
        db.sql(text)
    assert e.value.code == code


def test_wide_and_fine_quotients(spark):
    d = Database(spark)
    rows = [(1, Decimal("9e11"), Decimal("1e-10")), (2, Decimal("9e11"), Decimal("3e-10")), (3, Decimal("8e15"), Decimal("2e-10"))]
    d.register(EntitySchema("W", (FieldSpec("id", "int32"), FieldSpec("big", "decimal", scale=2), FieldSpec("fine", "decimal", scale=12)), ("id",)), spark.createDataFrame(rows, "id int, big decimal(38,2), fine decimal(38,12)"))
    got = d.sql("SELECT AVG(big) AS a, SUM(big) / COUNT(*) AS q, AVG(fine) AS f FROM w").first()
    assert got.a == got.q and abs(got.a - Decimal("8001800000000000") / 3) < Decimal("1e-5") and got.f == Decimal("2e-10")
    assert abs(d.sql("SELECT big / 7 AS x FROM w WHERE id = 1").first().x * 7 - Decimal("9e11")) < Decimal("1e-14")
    assert d.sql("SELECT fine / 4 AS x FROM w WHERE id = 1").first().x == Decimal("2.5e-11")


def test_walks_of_registered_tables_notice_changes(spark, tmp_path):
    schema = EntitySchema("T", (FieldSpec("id", "int32"),), ("id",))

    def opened():
        d = Database(spark, secret=b"k" * 32)
        d.register(schema, spark.read.parquet(f"{tmp_path}/t"))
        return d.query("T").order_by("id").limit(2)

    spark.range(5).selectExpr("cast(id as int) id").write.parquet(f"{tmp_path}/t")
    token = opened().execute_exhaustive_page().cursor
    assert [r.id for r in opened().execute_exhaustive_page(token).rows] == [2, 3]
    spark.range(5, 9).selectExpr("cast(id as int) id").write.mode("append").parquet(f"{tmp_path}/t")
    with pytest.raises(QueryError, match="restart_required"):
        opened().execute_exhaustive_page(token)


def test_runtime_errors(db):
    for text in ("SELECT rank / 0 FROM users", "SELECT SQRT(rank) AS x FROM users WHERE id = 4", "SELECT LN(0) FROM users", "SELECT LOG(1, 10) FROM users"):
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO|not_representable|USER_RAISED"):
            db.sql(text).collect()


def test_pushdown(db, spark, tmp_path):
    spark.range(100).selectExpr("cast(id as int) id", "cast(id % 7 as int) rank", "cast(id as string) name").write.parquet(f"{tmp_path}/t")
    d = Database(spark)
    d.register(EntitySchema("T", (FieldSpec("id", "int32"), FieldSpec("rank", "int32", True), FieldSpec("name", "text", True)), ("id",)), spark.read.parquet(f"{tmp_path}/t"))
    plan = d.sql("EXPLAIN VERBOSE SELECT id FROM t WHERE id + 5 < 12").first()[0]
    assert "LessThan(id,7)" in plan and "ReadSchema: struct<id:int>" in plan


def test_fluent(db):
    q = db.query("users")
    assert values(q.filter(field("rank").between(0, 5) & ~field("ok").is_null()).select("id").order_by("id").execute()) == [(1,), (5,)]
    assert values(q.filter(field("tags").contains_item("a")).select("id").order_by("id").execute()) == [(1,), (5,)]
    assert values(q.filter(field("name").eq_ci("ANN")).select("id").execute()) == [(1,)]
    assert values(q.filter(field("rank").gt_field("id")).select("id").order_by("id").execute()) == [(1,), (2,), (3,)]
    assert q.execute_exact_count() == 5 and q.filter(field("id") > 5).exists() is False
    assert (q.order_by("age").first(), q.order_by("age").last(), q.order_by_desc("age").first()) == (2, 4, 4)
    assert q.terminal(agg("max")) == 5 and q.group_by("rank").aggregate(m=agg("min")).execute().count() == 4
    assert [r and r.id for r in q.get_many([3, 9, 3])] == [3, None, 3] and q.get(9) is None
    with pytest.raises(QueryError, match="group_budget"):
        db.sql("SELECT id, COUNT(*) FROM users GROUP BY id", max_groups=3)


def test_pages(db):
    for exhaustive in (False, True):
        q = db.query("users").select("id", "age").order_by_desc("age").limit(2)
        pages = list(q.pages(exhaustive))
        assert [r.id for p in pages for r in p.rows] == [4, 3, 1, 5, 2] and len(pages) == 3
    token = q.execute_live_page().cursor
    with pytest.raises(QueryError, match="cursor_plan"):
        db.query("users").order_by("rank").limit(2).execute_live_page(token)
    with pytest.raises(QueryError, match="cursor_invalid"):
        q.execute_live_page(token[:-6] + "AAAA==")
    with pytest.raises(QueryError, match="cursor_offset"):
        q.offset(1).execute_live_page()
    g = db.query("users").group_by("rank").aggregate(n=agg("count")).limit(2)
    one = g.execute_grouped()
    two = g.execute_grouped(cursor=one.cursor)
    assert [(r.rank, r.n) for r in one.rows + two.rows] == [(-3, 1), (0, 1), (5, 2), (7, 1)] and two.cursor is None


def test_admission(db):
    for q, code in [("SELECT id FROM users", "full_scan"), ("SELECT id FROM users WHERE rank = 5", "limit_required"), ("SELECT id FROM users WHERE rank = 5 LIMIT 500", "row_bound"), ("SELECT id FROM users WHERE rank = 5 ORDER BY age LIMIT 5", "materialized_sort"), ("SELECT rank, COUNT(*) FROM users GROUP BY rank", "grouped_budget_required")]:
        with pytest.raises(QueryError) as e:
            db.sql(q, policy=PUBLIC)
        assert e.value.code == code
    assert db.sql("SELECT id FROM users WHERE rank = 5 ORDER BY id LIMIT 5", policy=PUBLIC).count() == 2
    assert db.sql("SELECT id FROM users WHERE id = 5", policy=PUBLIC).count() == 1


def test_fingerprint_is_canonical(db):
    from quillon.plans.select import fingerprint

    s = db.schema("users")
    same = [fingerprint(parse(t), s) for t in ("SELECT id FROM users WHERE id = 1 AND rank = 2", "SELECT id FROM users WHERE 2 = rank AND id = 1", "SELECT id FROM users WHERE NOT NOT (id = 1 AND rank = 2)")]
    assert len(set(same)) == 1
    assert fingerprint(parse("SELECT id FROM users WHERE id = 2 AND rank = 2"), s) != same[0]


def test_random_selects_against_duckdb(db, spark):
    """Seeded random statements over booleans, integers, texts and nulls."""
    rng = random.Random(7)
    frame = pd.DataFrame([r[:5] for r in ROWS], columns=["id", "name", "age", "rank", "ok"]).astype({"age": "Int64", "ok": "boolean"})
    duckdb.sql("SELECT 1")
    con = duckdb.connect()
    con.register("users_frame", frame)
    con.execute("CREATE TABLE users AS SELECT CAST(id AS INTEGER) AS id, name, CAST(age AS INTEGER) AS age, CAST(rank AS INTEGER) AS rank, CAST(ok AS BOOLEAN) AS ok FROM users_frame")

    def number():
        return rng.choice(["id", "age", "rank", "5", "-3", "2147483647", "(rank + 1)"])

    def condition(depth=0):
        k = rng.randrange(7 if depth < 3 else 4)
        if k == 0:
            return f"{number()} {rng.choice(['=', '<', '>=', '<>'])} {number()}"
        if k == 1:
            return f"{rng.choice(['age', 'name', 'ok'])} IS {rng.choice(['', 'NOT '])}NULL"
        if k == 2:
            return f"rank {rng.choice(['', 'NOT '])}IN (5, 7, {rng.choice(['0', 'NULL'])})"
        if k == 3:
            return f"age {rng.choice(['', 'NOT '])}BETWEEN 0 AND {rng.choice(['40', 'id', '100'])}"
        if k == 4:
            return f"NOT ({condition(depth + 1)})"
        return f"({condition(depth + 1)} {rng.choice(['AND', 'OR'])} {condition(depth + 1)})"

    for _ in range(40):
        text = f"SELECT id FROM users WHERE {condition()}"
        want = sorted(r[0] for r in con.execute(text).fetchall())
        assert sorted(r[0] for r in db.sql(text).collect()) == want, text


def test_normalizers_and_validators(spark):
    from quillon.functions import normalizers as Z
    from quillon.functions import validators as V

    def one(f, v, kind="string"):
        return spark.createDataFrame([(v,)], f"c {kind}").select(f(F.col("c"))).first()[0]

    cases = [(Z.kebab, "FooBar baz", "foo-bar-baz"), (Z.snake, "fooBarBAZQux", "foo_bar_baz_qux"), (Z.title, "foo_bar", "Foo Bar"), (Z.upper_camel, "foo bar", "FooBar"), (Z.upper_snake, "fooBar", "FOO_BAR"), (Z.trim, " \t x ", "x"), (Z.rgb_hex, "#a1b2c3", "A1B2C3"), (Z.rgb_hex, "zz", "FFFFFF"), (Z.rgba_hex, "a1b2c3", "A1B2C3FF"), (Z.mime_type, " Text/HTML ", "text/html"), (Z.url, "example.com/a", "https://example.com/a"), (Z.url, "example.com:80", "https://example.com:80"), (Z.e164, " 123 ", "+123"), (Z.e164, "12a", "12a"), (Z.iso_country, " de ", "DE"), (Z.numeric, "a1b2", "12"), (Z.snake, None, None)]
    for f, v, want in cases:
        assert one(f, v) == want, (f, v)
    with pytest.raises(Exception, match="http"):
        one(Z.url, "ftp://x")
    yes = [(V.snake, "foo_bar"), (V.camel, "fooBar"), (V.title, "Foo Bar"), (V.sentence, "Foo bar"), (V.upper_kebab, "FOO-BAR"), (V.mime_type, "a/b+c"), (V.url, "https://a-b.com:8/x?y"), (V.e164, "+1234567"), (V.iso_language, "en"), (lambda c: V.iso_country(c, spark), "DE"), (V.sha256_hex, "a" * 64), (V.ascii_only, "abc")]
    no = [(V.snake, "fooBar"), (V.mime_type, "a/b/c"), (V.url, "https://u@a.com"), (V.url, "https://-a.com"), (V.e164, "+0123456"), (V.iso_language, "xx"), (lambda c: V.iso_country(c, spark), "de"), (V.rgb_hex, "#a1b2c3"), (V.ascii_only, "é")]
    assert all(one(f, v) is True for f, v in yes) and all(one(f, v) is False for f, v in no), [(v, one(f, v)) for f, v in yes + no]
    assert one(lambda c: V.multiple_of(c, 0), 5, "int") is False and one(lambda c: V.max_decimal_places(c, 1), Decimal("1.50"), "decimal(4,2)") is True


def test_catalogue_matches_duckdb(spark):
    import os

    from quillon.plans import catalogue

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in os.listdir(d):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{d}/{t}'")
    made = catalogue.queries()
    for name in ("flagship", "global_window_input", "group_top_k", "order_case_nulls", "mutations", "ddl_columns", "live_pages", "nested_path", "is_empty_text", "collection_contains", "refused_grouped_order", "refused_inserts", "normalizer_cases", "validator_cases", "average_wide", "division_wide", "managed_fields", "show"):
        ours = made[name](spark, d).toPandas()
        theirs = con.execute(catalogue.oracle_sql()[name]).df()[list(ours.columns)]
        key = lambda p: sorted(map(repr, p.astype(object).where(p.notna(), None).map(lambda v: round(float(v), 4) if isinstance(v, (int, float)) and v is not True else str(v)).values.tolist()))
        assert key(ours) == key(theirs), name
