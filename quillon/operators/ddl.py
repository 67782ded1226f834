"""DDL, introspection and integrity checks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.errors import refuse
from quillon.functions.schema import CheckSpec, FieldSpec, IndexSpec, kind_of
from quillon.operators.mutate import check_expression, enforce, index_key, value_of, violations
from quillon.plans import nodes as N
from quillon.plans.compile import Scope, boolean
from quillon.plans.select import render

DEEP_PAGE = 100_000


class Definitions:
    """Mixed into Database."""

    def define(self, d: N.Ddl) -> DataFrame:
        a = d.args
        if d.action == "INTEGRITY":
            return self.integrity(d.entity, a["mode"])
        entity = d.entity
        if d.action == "DROP INDEX" and entity is None:
            owners = [n for n in self.store.names() if any(i.name == a["name"] for i in self.schema(n).indexes)]
            if not owners:
                return self._done(False) if a["quiet"] else refuse("unknown_index", a["name"])
            entity = owners[0]
        snap = self.snapshot(entity)
        s, rows = snap.schema, None
        fields = {f.name.lower(): f for f in s.fields}

        def put(f: FieldSpec) -> tuple[FieldSpec, ...]:
            return tuple(f if x.name == f.name else x for x in s.fields)

        if d.action == "CREATE INDEX":
            if any(i.name == a["name"] for i in s.indexes):
                return self._done(False) if a["quiet"] else refuse("index_exists", a["name"])
            keys = tuple(f"{k.name}({s.field(k.args[0].path[0]).name})" if isinstance(k, N.Func) else s.field(k.path[0]).name for k in a["keys"])
            where = render(a["where"]) if a["where"] is not None else None
            if a["unique"]:
                rows = self.rows(entity)
                rows = rows.filter(boolean(a["where"], Scope(s))) if a["where"] is not None else rows
                cols = [index_key(s, k).alias(f"k{i}") for i, k in enumerate(keys)]
                if not rows.select(*cols).dropna().groupBy(*[f"k{i}" for i in range(len(cols))]).count().filter("count > 1").isEmpty():
                    refuse("unique", f"{entity} has rows of one key")
            new = s.changed(indexes=(*s.indexes, IndexSpec(a["name"], keys, a["unique"], where, True)))
        elif d.action == "DROP INDEX":
            found = next((i for i in s.indexes if i.name == a["name"]), None)
            if found is None:
                return self._done(False) if a["quiet"] else refuse("unknown_index", a["name"])
            if not found.from_ddl:
                refuse("index_owner", f"{a['name']} belongs to the declared schema")
            new = s.changed(indexes=tuple(i for i in s.indexes if i.name != a["name"]))
        elif d.action == "ADD COLUMN":
            if a["name"].lower() in fields:
                refuse("field_exists", a["name"])
            f = kind_of(a["kind"], a["name"], nullable=a["nullable"])
            if a["default"] is not None:
                v = value_of(f, a["default"].value)
                v = v.hex() if isinstance(v, bytes) else v
                f = replace(f, default=v, has_default=True, since=snap.number + 1, added_default=v)
            elif not a["nullable"] and snap.files and not self.rows(entity).isEmpty():
                refuse("missing_value", f"{a['name']} is not null and needs a default")
            new = s.changed(fields=(*s.fields, f))
        elif d.action in ("SET DEFAULT", "DROP DEFAULT"):
            f = s.field(a["name"])
            new = s.changed(fields=put(replace(f, default=value_of(f, a["default"].value), has_default=True) if d.action == "SET DEFAULT" else replace(f, default=None, has_default=False)))
        elif d.action in ("SET NOT NULL", "DROP NOT NULL"):
            f = s.field(a["name"])
            if f.name in s.key:
                refuse("key_field", f.name)
            if d.action == "SET NOT NULL" and not self.rows(entity).filter(F.col(f"`{f.name}`").isNull()).isEmpty():
                refuse("constraint", f"{f.name} has nulls")
            new = s.changed(fields=put(replace(f, nullable=d.action == "DROP NOT NULL")))
        elif d.action == "RENAME COLUMN":
            f = s.field(a["name"])
            if a["to"].lower() in fields:
                refuse("field_exists", a["to"])
            if f.name in s.key or any(f.name in k for i in s.indexes for k in i.keys) or any(self._uses(c.expr, f.name) for c in s.checks):
                refuse("field_in_use", f"{f.name} is in a key, an index or a constraint")
            new = s.changed(fields=tuple(replace(f, name=a["to"], source=f.source or f.name) if x is f else x for x in s.fields))
        elif d.action == "DROP COLUMN":
            f = s.field(a["name"])
            if f.name in s.key or any(f.name in k for i in s.indexes for k in i.keys) or any(self._uses(c.expr, f.name) for c in s.checks):
                refuse("field_in_use", f.name)
            if not self.rows(entity).isEmpty():
                refuse("entity_not_empty", "a column of an entity with rows can't be dropped")
            new = s.changed(fields=tuple(x for x in s.fields if x is not f))
        elif d.action == "ADD CONSTRAINT":
            if any(c.name == a["name"] for c in s.checks):
                refuse("constraint_exists", a["name"])
            check = CheckSpec(a["name"], render(a["check"]), a["valid"])
            bad = boolean(a["check"], Scope(s))
            if a["valid"] and not self.rows(entity).filter(~bad).isEmpty():
                refuse("constraint", f"rows violate {a['name']}")
            new = s.changed(checks=(*s.checks, check))
        elif d.action == "VALIDATE CONSTRAINT":
            check = next((c for c in s.checks if c.name == a["name"]), None) or refuse("unknown_constraint", a["name"])
            enforce(self.rows(entity), [(f"check {check.name}", ~boolean(check_expression(check.expr), Scope(s)))])
            new = s.changed(checks=tuple(replace(c, valid=True) if c is check else c for c in s.checks))
        elif d.action == "DROP CONSTRAINT":
            if all(c.name != a["name"] for c in s.checks):
                refuse("unknown_constraint", a["name"])
            new = s.changed(checks=tuple(c for c in s.checks if c.name != a["name"]))
        else:
            refuse("unsupported", d.action)
        self.store.commit(new, snap.number + 1, snap.files, snap.sequence)
        return self._done(True)

    @staticmethod
    def _uses(expr: str, name: str) -> bool:
        return any(isinstance(x, N.Field) and x.path[0].lower() == name.lower() for x in N.walk(check_expression(expr)))

    def _done(self, changed: bool) -> DataFrame:
        return self.spark.createDataFrame([(changed,)], "changed boolean")

    def show(self, s: N.Show) -> DataFrame:
        make = self.spark.createDataFrame
        if s.what in ("ENTITIES", "STORES", "MEMORY"):
            names = self.entities()
            if s.what == "ENTITIES":
                return make([(n, self.schema(n).store, self.schema(n).version) for n in names], "entity string, store string, version int")
            if s.what == "STORES":
                return make([("journaled", self.store.root), ("heap", self.store.heap)], "store string, path string")
            return make([(n, f"{self.store.home(self.schema(n))}/{f}") for n in names if n.lower() not in self.registered for f in self.snapshot(n).files], "entity string, path string")
        e = self.schema(s.entity)
        if s.what == "ENTITY":
            return make([(e.name, ", ".join(e.key), e.store, e.version, e.fingerprint())], "entity string, primary_key string, store string, version int, fingerprint string")
        if s.what == "COLUMNS":
            rows = [(f.name, f.kind, f.nullable, f.name in e.key, None if not f.has_default else str(f.default), f.generated, f.relation) for f in e.fields]
            out = make(rows, "name string, kind string, nullable boolean, primary_key boolean, `default` string, generated string, relation string")
            return out if s.verbose else out.select("name", "kind", "nullable", "primary_key")
        if s.what == "INDEXES":
            return make([(i.name, ", ".join(i.keys), i.unique, i.where, i.from_ddl) for i in e.indexes], "name string, keys string, `unique` boolean, predicate string, from_ddl boolean")
        if s.what == "RELATIONS":
            return make([(f.name, f.relation, "many" if f.kind in ("list", "set") else "one") for f in e.fields if f.relation], "field string, target string, cardinality string")
        rows = [("primary key", "PRIMARY KEY", ", ".join(e.key), True)] + [(i.name, "UNIQUE", ", ".join(i.keys), True) for i in e.indexes if i.unique] + [(c.name, "CHECK", c.expr, c.valid) for c in e.checks]
        return make(rows, "name string, kind string, definition string, valid boolean")

    def integrity(self, entity: str, mode: str) -> DataFrame:
        """problem, rows. QUICK checks keys and nulls; DEEP also constraints, unique keys and relations.
        A DEEP check is one distributed pass here, so it ends in the START that begins it."""
        if mode in ("DEEP CONTINUE", "DEEP ABORT"):
            return self.spark.createDataFrame([], "problem string, rows long")
        e, df = self.schema(entity), self.rows(entity)
        parts = [(f"{f.name} is null", F.col(f"`{f.name}`").isNull()) for f in e.fields if not f.nullable]
        if mode != "QUICK":
            parts = violations(e, list(e.checks))
        counts = df.select(*[F.sum(F.when(bad, 1).otherwise(0)).cast("long").alias(f"c{i}") for i, (_, bad) in enumerate(parts)]).first()
        found = [(name, counts[i] or 0) for i, (name, _) in enumerate(parts)]
        keys = [("primary key twice", [F.col(f"`{k}`") for k in e.key])]
        if mode != "QUICK":
            keys += [(f"{i.name} twice", [index_key(e, k) for k in i.keys]) for i in e.indexes if i.unique]
        for name, cols in keys:
            names = [f"k{i}" for i in range(len(cols))]
            twice = df.select(*[c.alias(n) for c, n in zip(cols, names, strict=True)]).dropna().groupBy(*names).count().filter("count > 1").agg(F.sum("count").alias("n")).first()
            found.append((name, twice.n or 0))
        for f in e.fields if mode != "QUICK" else ():
            if f.relation:
                target = self.schema(f.relation)
                c = F.explode(F.col(f"`{f.name}`")) if f.kind in ("list", "set") else F.col(f"`{f.name}`")
                n = df.select(c.alias("ref")).dropna().join(self.rows(f.relation).select(F.col(f"`{target.key[0]}`").alias("ref")), "ref", "left_anti").count()
                found.append((f"{f.name} without target", n))
        return self.spark.createDataFrame([x for x in found if x[1]], "problem string, rows long")
