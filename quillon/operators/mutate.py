"""INSERT, UPDATE and DELETE as new versions of an entity's files.

All checks run against the rows as they will be: nullability, ranges, lengths, decimal scale, allowed enum
values, check constraints, unique keys and relations. A failed check leaves the entity as it was.
"""

from __future__ import annotations

import datetime as dt
import os
import time
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.errors import refuse
from quillon.functions.schema import RANGES, EntitySchema, FieldSpec
from quillon.plans import nodes as N
from quillon.plans.compile import Scope, boolean
from quillon.plans.select import sort_columns, total_order
from quillon.plans.sqltext import Parser

#: Most rows of an exact update, of a LIMITed update, and of one batch of entities.
EXACT_UPDATE, PREFIX_UPDATE, BATCH = 4096, 100, 64
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def new_ulid(now_ms: int | None = None) -> str:
    n = (now_ms if now_ms is not None else time.time_ns() // 1_000_000) << 80 | int.from_bytes(os.urandom(10), "big")
    return "".join(CROCKFORD[n >> 5 * i & 31] for i in range(25, -1, -1))


def ulid_column(columns: list[str]) -> Column:
    """A ULID for each row of one plan: the statement's time, and 80 bits that its seed, the row's place and the row
    decide, so the rows that are checked are the rows that are written."""
    seed, place = int.from_bytes(os.urandom(7), "big"), F.monotonically_increasing_id()
    halves = [F.xxhash64(F.lit(seed + k), place, *[F.col(f"`{c}`").cast("string") for c in columns]) for k in (0, 1)]
    chars = [F.substring(F.lit(CROCKFORD), (F.shiftrightunsigned(h, 5 * i).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for h in halves for i in range(8)]
    return F.concat(F.lit(new_ulid()[:10]), *chars)


def check_expression(text: str) -> Any:
    return Parser(text).expr()


def value_of(f: FieldSpec, x: Any) -> Any:
    """A Python value for a field, from a literal's value."""
    if x is None:
        return None
    if f.kind == "decimal":
        return Decimal(str(x)).quantize(Decimal(1).scaleb(-f.scale), ROUND_HALF_UP)
    if f.kind in ("nat64", "int128", "nat128"):
        return Decimal(x)
    if f.kind in ("float32", "float64"):
        return float(x)
    if f.kind == "timestamp" and isinstance(x, str):
        return dt.datetime.fromisoformat(x)
    if f.kind == "date" and isinstance(x, str):
        return dt.date.fromisoformat(x)
    if f.kind == "set" and x is not None:
        return list(dict.fromkeys(x))
    ok = {"bool": bool, "text": str, "ulid": str, "enum": str, "blob": (bytes, bytearray), "intbig": str, "natbig": str}.get(f.kind, int if f.kind in RANGES else object)
    if not isinstance(x, ok) or isinstance(x, bool) and f.kind != "bool":
        refuse("type_mismatch", f"{f.name} takes {f.kind}")
    return bytes(x) if f.kind == "blob" else x


def violations(schema: EntitySchema, checks: list) -> list[tuple[str, Column]]:
    """(what, condition of a violating row) of every row-local rule."""
    out = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        if not f.nullable:
            out.append((f"{f.name} is null", c.isNull()))
        if f.kind in RANGES:
            low, high = RANGES[f.kind]
            out.append((f"{f.name} is out of range", (c < F.lit(Decimal(low))) | (c > F.lit(Decimal(high)))))
        if f.max_len is not None:
            out.append((f"{f.name} is too long", (F.octet_length(c) if f.kind == "blob" else F.char_length(c)) > f.max_len))
        if f.values:
            out.append((f"{f.name} is no allowed value", ~c.isin(list(f.values))))
    scope = Scope(schema)
    return out + [(f"check {k.name}", ~boolean(check_expression(k.expr), scope)) for k in checks]


def broken(df: DataFrame, rules: list[tuple[str, Column]]) -> list[DataFrame]:
    """Problems (code, what) of rows that break row-local rules."""
    if not rules:
        return []
    what = F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in rules])
    return [df.select(F.lit("constraint").alias("code"), what.alias("what")).filter("what is not null")]


def problem(df: DataFrame, code: str, what: str) -> DataFrame:
    """A problem for each row of df."""
    return df.select(F.lit(code).alias("code"), F.lit(what).alias("what"))


def settle(problems: list[DataFrame]) -> None:
    """Refuses if there is any problem. All checks run as one job."""
    if problems:
        found = reduce(DataFrame.unionByName, problems).limit(1).collect()
        if found:
            refuse(found[0].code, found[0].what)


def enforce(df: DataFrame, rules: list[tuple[str, Column]]) -> None:
    settle(broken(df, rules))


def index_key(schema: EntitySchema, key: str) -> Column:
    name, _, inner = key.partition("(")
    if inner:
        from quillon.functions.scalar import trim

        c = F.col(f"`{schema.field(inner[:-1]).name}`")
        return {"LOWER": F.lower, "UPPER": F.upper, "TRIM": lambda x: trim(x, True, True)}[name](c)
    return F.col(f"`{schema.field(key).name}`")


class Mutations:
    """Mixed into Database."""

    def _unique(self, schema: EntitySchema, old: DataFrame | None, new: DataFrame) -> list[DataFrame]:
        """No primary or unique key of new occurs in new again or in old. Rows with a null key part are apart."""
        out: list[DataFrame] = []
        keys = [("primary key", [F.col(f"`{k}`") for k in schema.key], None)]
        keys += [(i.name, [index_key(schema, k) for k in i.keys], i.where) for i in schema.indexes if i.unique]
        for name, cols, where in keys:
            pick = lambda df, where=where, cols=cols: (df.filter(boolean(check_expression(where), Scope(schema))) if where else df).select(*[c.alias(f"k{i}") for i, c in enumerate(cols)]).dropna()
            mine, names = pick(new), [f"k{i}" for i in range(len(cols))]
            found = [mine.groupBy(*names).count().filter("count > 1")] + ([pick(old).join(mine, names, "left_semi")] if old is not None else [])
            out += [problem(x, "unique", f"{schema.name}: {name} is taken") for x in found]
        return out

    def _relations(self, schema: EntitySchema, new: DataFrame, final: dict[str, DataFrame]) -> list[DataFrame]:
        """Problems of non-null references of new without a target in the rows as they will be."""
        out = []
        for f in schema.fields:
            if f.relation:
                target = self.schema(f.relation)
                rows = final.get(f.relation.lower())
                rows = self.rows(f.relation) if rows is None else rows
                c = F.explode(F.col(f"`{f.name}`")) if f.kind in ("list", "set") else F.col(f"`{f.name}`")
                want = new.select(c.alias("ref")).dropna()
                lost = want.join(rows.select(F.col(f"`{target.key[0]}`").alias("ref")), "ref", "left_anti")
                out.append(problem(lost, "relation", f"{schema.name}.{f.name} has no target in {f.relation}"))
        return out

    def _blocked(self, schema: EntitySchema, gone: DataFrame, final: dict[str, DataFrame]) -> list[DataFrame]:
        """Problems of rows of any entity that refer to a row that goes."""
        out = []
        for name in self.store.names():
            other = self.schema(name)
            for f in other.fields:
                if f.relation and f.relation.lower() == schema.name.lower():
                    rows = final.get(name.lower())
                    rows = self.rows(name) if rows is None else rows
                    c = F.explode(F.col(f"`{f.name}`")) if f.kind in ("list", "set") else F.col(f"`{f.name}`")
                    held = rows.select(c.alias("ref")).dropna().join(gone.select(F.col(f"`{schema.key[0]}`").alias("ref")), "ref", "left_semi")
                    out.append(problem(held, "relation", f"{name}.{f.name} refers to a row of {schema.name} that would go"))
        return out

    def _filled(self, schema: EntitySchema, given: list[dict[str, Any]], sequence: int) -> tuple[list[tuple], int]:
        """Complete rows, with defaults and generated values."""
        rows, now = [], dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        now = now.replace(microsecond=now.microsecond // 1000 * 1000)
        for g in given:
            row = []
            for f in schema.fields:
                v = g.get(f.name, N.DEFAULT)
                if v is N.DEFAULT:
                    if f.generated == "ulid":
                        v = new_ulid()
                    elif f.generated == "identity":
                        sequence += 1
                        v = sequence
                    elif f.generated in ("created_at", "updated_at"):
                        v = now
                    else:
                        if not f.has_default and not f.nullable:
                            refuse("missing_value", f"{schema.name}.{f.name} has no default")
                        v = f.default if f.has_default else None
                elif f.generated in ("created_at", "updated_at"):
                    refuse("managed_field", f.name)
                row.append(value_of(f, v))
            rows.append(tuple(row))
        return rows, sequence

    def insert_rows(self, entity: str, rows: list[dict[str, Any]]) -> DataFrame:
        """Inserts rows given as dicts; all or none. Returns them as stored."""
        snap = self.snapshot(entity)
        schema = snap.schema
        known = [{schema.field(k).name: v for k, v in r.items()} for r in rows]
        full, sequence = self._filled(schema, known, snap.sequence)
        try:
            new = self.spark.createDataFrame(full, schema.spark(), verifySchema=False)
        except Exception as e:  # a value that its Spark type can't hold
            refuse("type_mismatch", str(e).splitlines()[0])
        return self.insert_frame(entity, new, snap, sequence)

    def insert_frame(self, entity: str, new: DataFrame, snap=None, sequence: int | None = None) -> DataFrame:
        """Inserts a DataFrame with the entity's columns."""
        snap = snap or self.snapshot(entity)
        schema = snap.schema
        new = new.select(*[new[f.name].cast(f.spark_type()).alias(f.name) for f in schema.fields])
        old = self.store.read(snap) if snap.files else None
        settle(broken(new, violations(schema, list(schema.checks))) + self._unique(schema, old, new) + self._relations(schema, new, {schema.name.lower(): new if old is None else old.unionByName(new)}))
        files = self.store.write(schema, new, snap.number + 1)
        done = self.store.commit(schema, snap.number + 1, snap.files + files, snap.sequence if sequence is None else sequence)
        return self.store.read(done, files)

    def insert(self, s: N.Insert) -> DataFrame:
        snap = self.snapshot(s.entity)
        schema = snap.schema
        names = [schema.field(c).name for c in s.columns] if s.columns else [f.name for f in schema.fields if not f.generated or s.rows and s.rows[0] and len(s.rows[0]) == len(schema.fields)]
        if s.select is not None:
            picked = self.select(s.select, max_groups=None)
            if len(picked.columns) != len(names):
                refuse("insert_width", "the SELECT has another number of columns")
            picked = picked.toDF(*names)
            if any(f.generated == "identity" and f.name not in names for f in schema.fields):
                refuse("insert_select_identity", "INSERT SELECT gives identities explicitly")
            now = F.lit(dt.datetime.now(dt.timezone.utc))
            fill = {"ulid": ulid_column(picked.columns), "created_at": now, "updated_at": now}
            for f in schema.fields:
                if f.name not in names:
                    if not (f.generated or f.has_default or f.nullable):
                        refuse("missing_value", f.name)
                    picked = picked.withColumn(f.name, fill[f.generated] if f.generated else F.lit(f.default).cast(f.spark_type()))
            new = self.insert_frame(s.entity, picked, snap)
        else:
            rows = s.rows or ((),)
            if s.rows and any(len(r) != len(names) for r in rows):
                refuse("insert_width", "a row has another number of values than columns")
            lits = [dict(zip(names, (N.DEFAULT if v.kind == "default" else v.value for v in r), strict=False)) for r in rows]
            new = self.insert_rows(s.entity, lits)
        return self._returning(schema, new, s.returning)

    def _returning(self, schema: EntitySchema, rows: DataFrame, fields: tuple | None) -> DataFrame:
        """Returned rows, or their number as `affected`."""
        if fields is None:
            return self.spark.createDataFrame([(rows.count(),)], "affected long")  # local rows or new files: cheap
        names = [schema.field(f.path[0]).name for f in fields] or [f.name for f in schema.fields]
        return rows.select(*names)

    def _touched(self, snap, s: N.Update | N.Delete) -> DataFrame:
        """Rows that the statement selects, with their file."""
        scope = Scope(snap.schema)
        df = self.store.read(snap, with_file=True)
        if s.where is not None:
            df = df.filter(boolean(s.where, scope))
        offset = getattr(s, "offset", None)
        if s.limit is not None or offset:
            df = df.orderBy(*sort_columns(total_order(N.Select(s.entity, order=s.order), scope)))
            df = df.offset(offset) if offset else df
            df = df.limit(s.limit) if s.limit is not None else df
        return df

    def update(self, s: N.Update, most: int = EXACT_UPDATE) -> DataFrame:
        snap = self.snapshot(s.entity)
        schema = snap.schema
        sets = {}
        for name, lit in s.sets:
            f = schema.field(name)
            if f.name in schema.key:
                refuse("key_update", "primary keys don't change")
            if f.generated in ("created_at", "updated_at"):
                refuse("managed_field", f.name)
            if f.name in sets:
                refuse("duplicate_assignment", f.name)
            sets[f.name] = value_of(f, (f.default if f.has_default else None) if lit.kind == "default" else lit.value)
        if s.limit is not None and s.limit > PREFIX_UPDATE:
            refuse("update_limit", f"an update is limited to {PREFIX_UPDATE} rows")
        rows = self._touched(snap, s).limit(most + 1).collect()  # bounded by the policy
        if len(rows) > most:
            refuse("update_bound", f"an exact update touches at most {most} rows")
        if not rows:
            return self._returning(schema, self.spark.createDataFrame([], schema.spark()), s.returning)
        now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        stamp = {f.name: now for f in schema.fields if f.generated == "updated_at"}
        after = [tuple((sets | stamp).get(f.name, r[f.name]) for f in schema.fields) for r in rows]
        new = self.spark.createDataFrame(after, schema.spark(), verifySchema=False)
        touched = tuple(sorted({r["__file"] for r in rows}))
        keys = self.spark.createDataFrame([tuple(r[k] for k in schema.key) for r in rows], new.select(*schema.key).schema)
        final_old = self.store.read(snap).join(F.broadcast(keys), list(schema.key), "left_anti").select(*[f.name for f in schema.fields])
        settle(broken(new, violations(schema, list(schema.checks))) + self._unique(schema, final_old, new) + self._relations(schema, new, {schema.name.lower(): final_old.unionByName(new)}))
        rest = self.store.read(snap, touched).join(F.broadcast(keys), list(schema.key), "left_anti").select(*[f.name for f in schema.fields])
        files = self.store.write(schema, rest.unionByName(new), snap.number + 1)
        self.store.commit(schema, snap.number + 1, tuple(f for f in snap.files if f not in touched) + files, snap.sequence)
        return self._returning(schema, new, s.returning)

    def delete(self, s: N.Delete) -> DataFrame:
        snap = self.snapshot(s.entity)
        schema = snap.schema
        names = [f.name for f in schema.fields]
        keys = list(schema.key)
        rows = self._touched(snap, s).limit(EXACT_UPDATE + 1).collect()
        if len(rows) <= EXACT_UPDATE:  # few rows are held here, any number is held in files
            gone = self.spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema.spark(), verifySchema=False)
            touched = tuple(sorted({r["__file"] for r in rows}))
        else:
            files = self.store.write(schema, self._touched(snap, s).select(*names), snap.number + 1)
            gone = self.store.read(snap, files)
            left = self.store.read(snap, with_file=True).join(gone.select(*keys), keys, "left_semi").select("__file").distinct()
            touched = tuple(r[0] for r in left.collect())  # a row for each file
        if not rows:
            return self._returning(schema, gone, s.returning)
        final = self.store.read(snap).join(gone.select(*keys), keys, "left_anti").select(*names)
        settle(self._blocked(schema, gone, {schema.name.lower(): final}))
        rest = self.store.read(snap, touched).join(gone.select(*keys), keys, "left_anti").select(*names)
        new = self.store.write(schema, rest, snap.number + 1)
        self.store.commit(schema, snap.number + 1, tuple(f for f in snap.files if f not in touched) + new, snap.sequence)
        return self._returning(schema, gone, s.returning)

    # structural writes, by primary key

    def _by_key(self, schema: EntitySchema, key: dict[str, Any]) -> Any:
        if {schema.field(k).name for k in key} != set(schema.key):
            refuse("key", f"{schema.name} is keyed by {', '.join(schema.key)}")
        kind = lambda v: "text" if isinstance(v, str) else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "blob" if isinstance(v, bytes) else "decimal"
        return reduce(lambda a, b: N.Binary("AND", a, b), [N.Binary("=", N.Field((k,)), N.Lit(v, kind(v))) for k, v in key.items()])

    def update_row(self, entity: str, key: dict[str, Any], values: dict[str, Any]) -> DataFrame:
        """The row of a key with other values; an unknown key is an error."""
        sets = tuple((k, N.Lit(v, "value")) for k, v in values.items())
        out = self.update(N.Update(entity, sets, self._by_key(self.schema(entity), key), returning=()))
        return out if not out.isEmpty() else refuse("not_found", f"{entity} has no such row")

    def delete_row(self, entity: str, key: dict[str, Any]) -> bool:
        return self.delete(N.Delete(entity, self._by_key(self.schema(entity), key))).first().affected == 1

    def replace_row(self, entity: str, row: dict[str, Any]) -> DataFrame:
        """Puts a whole row in the place of the one with its key, or inserts it."""
        snap = self.snapshot(entity)
        schema = snap.schema
        full, sequence = self._filled(schema, [{schema.field(k).name: v for k, v in row.items()}], snap.sequence)
        new = self.spark.createDataFrame(full, schema.spark(), verifySchema=False)
        keys, names = list(schema.key), [f.name for f in schema.fields]
        old = self.store.read(snap, with_file=True)
        touched = tuple(r[0] for r in old.join(F.broadcast(new.select(*keys)), keys, "left_semi").select("__file").distinct().collect())
        rest = old.join(F.broadcast(new.select(*keys)), keys, "left_anti").select(*names)
        settle(broken(new, violations(schema, list(schema.checks))) + self._unique(schema, rest, new) + self._relations(schema, new, {schema.name.lower(): rest.unionByName(new)}))
        kept = self.store.read(snap, touched).join(F.broadcast(new.select(*keys)), keys, "left_anti").select(*names)
        files = self.store.write(schema, kept.unionByName(new), snap.number + 1)
        self.store.commit(schema, snap.number + 1, tuple(f for f in snap.files if f not in touched) + files, sequence)
        return new

    def batch(self, inserts: dict[str, list[dict[str, Any]]]) -> dict[str, int]:
        """Inserts into several entities, checked against what all of them will be; at most BATCH rows.

        Children may come before their parents. A check that fails leaves every entity as it was; the commits
        themselves follow each other, and those of a conflict are undone.
        """
        if sum(map(len, inserts.values())) > BATCH:
            refuse("batch_size", f"a batch has at most {BATCH} rows")
        final, made = {}, {}
        for name, rows in inserts.items():
            snap = self.snapshot(name)
            full, sequence = self._filled(snap.schema, [{snap.schema.field(k).name: v for k, v in r.items()} for r in rows], snap.sequence)
            new = self.spark.createDataFrame(full, snap.schema.spark(), verifySchema=False)
            old = self.store.read(snap)
            settle(broken(new, violations(snap.schema, list(snap.schema.checks))) + self._unique(snap.schema, old, new))
            final[name.lower()], made[name] = old.unionByName(new), (snap, new, sequence)
        if len({snap.schema.store for snap, _, _ in made.values()}) > 1:
            refuse("batch_store", "a batch stays in one store")
        settle([x for snap, new, _ in made.values() for x in self._relations(snap.schema, new, final)])
        staged = {name: self.store.write(snap.schema, new, snap.number + 1) for name, (snap, new, _) in made.items()}
        done: list = []
        try:
            for name, (snap, _, sequence) in made.items():
                done.append(self.store.commit(snap.schema, snap.number + 1, snap.files + staged[name], sequence))
        except Exception:
            for d in done:
                self.store.files.delete(f"{self.store.home(d.schema)}/_versions/{d.number:08d}.json")
            raise
        return {name: len(rows) for name, rows in inserts.items()}
