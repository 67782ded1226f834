"""Writes: atomicity, constraints, relations, DDL, jobs."""

import pytest

from quillon.functions.errors import QueryError
from quillon.functions.schema import CheckSpec, EntitySchema, FieldSpec, IndexSpec
from quillon.operators.database import Database
from quillon.streaming.jobs import MutationJob, ResumableJob


@pytest.fixture
def db(spark, tmp_path):
    d = Database(spark, f"file://{tmp_path}")
    d.create(EntitySchema("Team", (FieldSpec("id", "int32"), FieldSpec("name", "text", max_len=5)), ("id",), (IndexSpec("u", ("LOWER(name)",), True),)))
    fields = (FieldSpec("id", "nat64", generated="identity"), FieldSpec("team", "int32", True, relation="Team"), FieldSpec("level", "nat8", default=1, has_default=True), FieldSpec("made", "timestamp", generated="created_at"), FieldSpec("changed", "timestamp", generated="updated_at"))
    d.create(EntitySchema("Player", fields, ("id",), checks=(CheckSpec("cap", "level <= 200"),)))
    d.sql("INSERT INTO Team VALUES (1, 'red'), (2, 'blue')")
    return d


def code(f):
    with pytest.raises(QueryError) as e:
        f()
    return e.value.code


def test_insert(db):
    got = db.sql("INSERT INTO Player (team, level) VALUES (1, 5), (2, DEFAULT), (NULL, 7) RETURNING id, team, level").collect()
    assert [(int(r.id), r.team, r.level) for r in got] == [(1, 1, 5), (2, 2, 1), (3, None, 7)]
    assert db.sql("INSERT INTO Player DEFAULT VALUES RETURNING id").first().id == 4
    before = db.revision("Player")
    for text, want in [("INSERT INTO Player (team) VALUES (9)", "relation"), ("INSERT INTO Player (level) VALUES (201)", "constraint"), ("INSERT INTO Player (level) VALUES (300)", "constraint"), ("INSERT INTO Team VALUES (3, 'toolong')", "constraint"), ("INSERT INTO Team VALUES (3, 'RED')", "unique"), ("INSERT INTO Team VALUES (1, 'x')", "unique"), ("INSERT INTO Team VALUES (3, 'a'), (3, 'b')", "unique"), ("INSERT INTO Team (id) VALUES (3)", "missing_value"), ("INSERT INTO Team VALUES (3)", "insert_width"), ("INSERT INTO Team VALUES ('x', 'y')", "type_mismatch")]:
        assert code(lambda text=text: db.sql(text)) == want, text
    assert db.revision("Player") == before and db.sql("SELECT COUNT(*) AS n FROM Team").first().n == 2
    assert db.sql("INSERT INTO Player (team, level) VALUES (1, 9)").first().affected == 1


def test_update_delete(db):
    db.sql("INSERT INTO Player (team, level) VALUES (1, 5), (1, 6), (2, 7)")
    assert db.sql("UPDATE Player SET level = 9 WHERE team = 1 RETURNING id, level").count() == 2
    assert sorted(r.level for r in db.sql("SELECT level FROM Player").collect()) == [7, 9, 9]
    assert code(lambda: db.sql("UPDATE Player SET id = 1")) == "key_update"
    assert code(lambda: db.sql("UPDATE Player SET level = 255")) == "constraint"
    assert code(lambda: db.sql("UPDATE Player SET level = level")) in ("syntax", "literal_expected")
    assert code(lambda: db.sql("UPDATE Player SET level = 1 LIMIT 101")) == "update_limit"
    assert code(lambda: db.sql("DELETE FROM Team WHERE id = 1")) == "relation"
    assert db.sql("DELETE FROM Player WHERE team = 1 ORDER BY id DESC LIMIT 1 RETURNING id").first().id == 2
    assert db.sql("DELETE FROM Player").first().affected == 2 and db.sql("DELETE FROM Team WHERE id = 1").first().affected == 1


def test_batch_sees_its_final_state(db):
    assert db.batch({"Player": [{"team": 7}], "Team": [{"id": 7, "name": "g"}]}) == {"Player": 1, "Team": 1}
    assert code(lambda: db.batch({"Player": [{"team": 8}]})) == "relation"


def test_conflicting_commits(db):
    snap = db.snapshot("Team")
    db.sql("INSERT INTO Team VALUES (5, 'e')")
    assert code(lambda: db.store.commit(snap.schema, snap.number + 1, ())) == "conflict"


def test_exhaustive_walk_restarts(db):
    q = db.query("Team").limit(1)
    token = q.execute_exhaustive_page().cursor
    db.sql("INSERT INTO Team VALUES (5, 'e')")
    assert code(lambda: q.execute_exhaustive_page(token)) == "restart_required"


def test_ddl(db):
    db.sql("ALTER TABLE Team ADD COLUMN size Int32 DEFAULT 3")
    db.sql("INSERT INTO Team (id, name) VALUES (3, 'c')")
    assert [r["size"] for r in db.sql("SELECT size FROM Team").collect()] == [3, 3, 3]
    db.sql("ALTER TABLE Team ALTER COLUMN size SET DEFAULT 8")
    db.sql("ALTER TABLE Team RENAME COLUMN size TO seats")
    db.sql("INSERT INTO Team (id, name) VALUES (4, 'd')")
    assert sorted(r.seats for r in db.sql("SELECT seats FROM Team").collect()) == [3, 3, 3, 8]
    assert code(lambda: db.sql("ALTER TABLE Team DROP COLUMN seats")) == "entity_not_empty"
    assert code(lambda: db.sql("ALTER TABLE Team RENAME COLUMN name TO n")) == "field_in_use"
    assert code(lambda: db.sql("ALTER TABLE Team ADD CONSTRAINT few CHECK (seats < 5)")) == "constraint"
    db.sql("ALTER TABLE Team ADD CONSTRAINT few CHECK (seats < 5) NOT VALID")
    assert code(lambda: db.sql("ALTER TABLE Team VALIDATE CONSTRAINT few")) == "constraint"
    db.sql("ALTER TABLE Team DROP CONSTRAINT few")
    assert code(lambda: db.sql("CREATE UNIQUE INDEX s ON Team (seats)")) == "unique"
    db.sql("CREATE INDEX IF NOT EXISTS s ON Team (seats)")
    assert db.sql("SHOW INDEXES Team").count() == 2 and code(lambda: db.sql("DROP INDEX u ON Team")) == "index_owner"
    db.sql("DROP INDEX s")
    assert db.sql("DROP INDEX IF EXISTS s").first().changed is False
    assert [r.name for r in db.sql("DESCRIBE Team").collect()] == ["id", "name", "seats"]
    assert {r.kind for r in db.sql("SHOW CONSTRAINTS Player").collect()} == {"PRIMARY KEY", "CHECK"} and db.sql("SHOW RELATIONS Player").first().target == "Team"
    assert db.sql("SHOW ENTITIES").count() == 2 and db.sql("SHOW MEMORY").count() >= 1 and db.sql("SHOW STORES").count() == 2
    assert db.sql("CHECK INTEGRITY QUICK Team").count() == 0 and db.sql("CHECK INTEGRITY DEEP START Player").count() == 0
    assert "full_scan" in db.sql("EXPLAIN SELECT * FROM Team WHERE seats = 1").first().plan and db.sql("EXPLAIN JSON DELETE FROM Team WHERE id = 1").first().plan.startswith("{")


def test_jobs(db):
    job = ResumableJob(db, "count")
    assert job.run(lambda n: ((n or 0) + 1, (n or 0) == 4), most=2) == 2 and job.run(lambda n: (n + 1, n == 4)) == 5
    assert code(lambda: job.advance(1, {})) == "job_conflict"
    for k in range(3):
        db.insert_rows("Player", [{"level": 3} for _ in range(150)])
    m = MutationJob(db, "lift", "UPDATE Player SET level = 4 WHERE level = 3")
    assert m.run(1)["phase"] == "forward"
    assert MutationJob(db, "lift", "UPDATE Player SET level = 4 WHERE level = 3").run()["updated"] == 450
    assert db.sql("SELECT COUNT(*) AS n FROM Player WHERE level = 4").first().n == 450
    assert code(lambda: MutationJob(db, "lift", "UPDATE Player SET level = 5").step({"text": "other"})) == "idempotency"


def test_heap_store_and_dynamic(db, spark):
    db.create(EntitySchema("Tmp", (FieldSpec("id", "ulid", generated="ulid"), FieldSpec("v", "text", True)), ("id",), store="heap"))
    db.sql("INSERT INTO Tmp (v) VALUES ('a'), (NULL)")
    assert db.dynamic({"entity": "tmp", "select": ["v"], "where": "v IS NOT NULL", "order": [["v", False]], "limit": 5}).collect()[0].v == "a"
    assert len(db.sql("SELECT id FROM Tmp").first().id) == 26
    assert code(lambda: db.dynamic({"entity": "tmp", "join": "x"})) == "dynamic_request"


def test_structural_writes(db):
    db.insert_rows("Player", [{"team": 1, "level": 3}])
    assert db.update_row("Player", {"id": 1}, {"level": 8}).first().level == 8
    assert code(lambda: db.update_row("Player", {"id": 9}, {"level": 8})) == "not_found" and code(lambda: db.update_row("Player", {"team": 1}, {})) == "key"
    db.replace_row("Team", {"id": 2, "name": "teal"})
    db.replace_row("Team", {"id": 6, "name": "new"})
    assert sorted((r.id, r.name) for r in db.rows("Team").collect()) == [(1, "red"), (2, "teal"), (6, "new")]
    assert code(lambda: db.replace_row("Team", {"id": 6, "name": "RED"})) == "unique"
    assert db.delete_row("Team", {"id": 6}) is True and db.delete_row("Team", {"id": 6}) is False


def test_migrations(db):
    from quillon.operators.migrate import Migration

    fields = db.schema("Team").fields
    m = Migration(1, (fields[0], FieldSpec("label", "text"), FieldSpec("size", "int64"), FieldSpec("note", "text", True)), {"size": "LENGTH(name) + 1", "label": "UPPER(name)"})
    assert code(lambda: db.migrate("Team", [Migration(5, fields)])) == "migration_gap"
    db.store.commit(db.schema("Team").changed(indexes=()), db.snapshot("Team").number + 1, db.snapshot("Team").files)
    assert db.migrate("Team", [Migration(2, m.fields, m.values)]) == 3 and db.migrate("Team", [Migration(2, m.fields, m.values)]) == 3
    assert sorted(tuple(r) for r in db.rows("Team").collect()) == [(1, "RED", 4, None), (2, "BLUE", 5, None)]


def test_group_budgets(db):
    from quillon.operators.fluent import agg
    from quillon.plans.admission import GroupLimits

    db.insert_rows("Player", [{"team": 1 + k % 2, "level": k} for k in range(10)])
    q = db.query("Player").group_by("team").aggregate(n=agg("count", "level", distinct=True))
    assert [r.n for r in q.execute_grouped().rows] == [5, 5]
    for limits, want in [(GroupLimits(1), "group_budget"), (GroupLimits(10, 2), "group_bytes"), (GroupLimits(10, 999, 9), "distinct_budget")]:
        assert code(lambda limits=limits: q.execute_grouped(limits)) == want
    assert len(db.query("Player").execute_complete_small_set(10)) == 10 and code(lambda: db.query("Player").execute_complete_small_set(9)) == "complete_set"


def test_large_delete_goes_through_files(db, monkeypatch):
    from quillon.operators import mutate

    monkeypatch.setattr(mutate, "EXACT_UPDATE", 2)
    db.insert_rows("Player", [{"team": 1 + k % 2, "level": k} for k in range(10)])
    assert sorted(r.level for r in db.sql("DELETE FROM Player WHERE team = 1 RETURNING level").collect()) == [0, 2, 4, 6, 8]
    assert sorted(r.level for r in db.rows("Player").collect()) == [1, 3, 5, 7, 9]
    db.insert_rows("Player", [{"team": 2}])
    assert code(lambda: db.sql("DELETE FROM Team")) == "relation"
