"""The database: entities, SQL and fluent entry points."""

from __future__ import annotations

import hashlib
import json
import secrets
import time
from collections import Counter, OrderedDict
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quillon.functions.errors import refuse
from quillon.functions.schema import EntitySchema
from quillon.operators.ddl import Definitions
from quillon.operators.migrate import Migrations
from quillon.operators.fluent import Query
from quillon.operators.mutate import Mutations
from quillon.plans import nodes as N
from quillon.plans.admission import TRUSTED, Policy, admit
from quillon.plans.explain import explain
from quillon.plans.select import SQL_GROUPS, Source, fingerprint, run
from quillon.plans.sqltext import parse
from quillon.sources.store import Snapshot, Store

SHAPES, CACHED = 32, 256


class Database(Mutations, Definitions, Migrations):
    """Entities that are created here live in the store under root; registered ones are read-only tables."""

    def __init__(self, spark: SparkSession, root: str | None = None, secret: bytes | None = None) -> None:
        self.spark, self.store, self.secret = spark, Store(spark, root), secret or secrets.token_bytes(32)
        self.registered: dict[str, Source] = {}
        self._parsed: OrderedDict[str, Any] = OrderedDict()
        self.metrics: OrderedDict[str, dict] = OrderedDict()
        self.intents: Counter = Counter()

    # entities
    def create(self, schema: EntitySchema) -> None:
        if schema.name.lower() in self.registered or self.store.find(schema.name):
            refuse("entity_exists", schema.name)
        self.store.commit(schema, 1, ())

    def register(self, schema: EntitySchema, df: DataFrame) -> None:
        """A table to read: the schema is declared, and its columns must be the table's."""
        have = {f.name: f.dataType for f in df.schema}
        missing = [f.name for f in schema.fields if f.name not in have]
        if missing:
            refuse("schema", f"{schema.name} has no column {missing[0]}")
        self.registered[schema.name.lower()] = Source(schema, df)

    def entities(self) -> list[str]:
        return sorted([*self.store.names(), *(s.schema.name for s in self.registered.values())])

    def snapshot(self, entity: str) -> Snapshot:
        if entity.lower() in self.registered:
            refuse("read_only", f"{entity} is a registered table")
        found = self.store.find(entity)
        return self.store.current(found[0]) if found else refuse("unknown_entity", entity)

    def source(self, entity: str) -> Source:
        if (found := self.registered.get(entity.lower())) is not None:
            return found
        snap = self.snapshot(entity)
        return Source(snap.schema, self.store.read(snap))

    def schema(self, entity: str) -> EntitySchema:
        return self.registered[entity.lower()].schema if entity.lower() in self.registered else self.snapshot(entity).schema

    def rows(self, entity: str) -> DataFrame:
        return self.source(entity).df

    def revision(self, entity: str) -> str:
        """What an exhaustive walk is bound to: a version, or a registered table's files with their lengths and times."""
        if (found := self.registered.get(entity.lower())) is not None:
            return "registered:" + hashlib.sha256("\n".join(self._files(found.df)).encode()).hexdigest()
        snap = self.snapshot(entity)
        return f"{snap.schema.name}@{snap.number}"

    def _files(self, df: DataFrame) -> list[str]:
        """A line for each file of df; for rows that are in no file, the plan that makes them."""
        jvm, conf, out = self.spark._jvm, self.spark._jsc.hadoopConfiguration(), []
        for name in sorted(df.inputFiles()):
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
            status = path.getFileSystem(conf).getFileStatus(path)
            out.append(f"{name} {status.getLen()} {status.getModificationTime()}")
        return out or [str(df.semanticHash())]

    # statements
    def parse(self, text: str) -> Any:
        if text not in self._parsed:
            self._parsed[text] = parse(text)
            if len(self._parsed) > CACHED:
                self._parsed.popitem(last=False)
        return self._parsed[text]

    def select(self, s: N.Select, policy: Policy = TRUSTED, max_groups: int | None = SQL_GROUPS) -> DataFrame:
        src = self.source(s.entity)
        admit(s, src.schema, policy)
        shape = fingerprint(s, src.schema)[:16]
        began = time.perf_counter()
        out = run(s, src, max_groups)
        m = self.metrics.setdefault(shape, {"entity": s.entity, "runs": 0, "plan_s": 0.0})
        m["runs"] += 1
        m["plan_s"] += time.perf_counter() - began
        if len(self.metrics) > SHAPES:
            self.metrics.popitem(last=False)
        return out

    def sql(self, text: str, policy: Policy = TRUSTED, max_groups: int | None = SQL_GROUPS) -> DataFrame:
        """The result of one statement. Grouped ones of more than max_groups groups fail; None lifts that
        and keeps the result lazy."""
        s = self.parse(text)
        if isinstance(s, N.Select):
            return self.select(s, policy, max_groups)
        if isinstance(s, N.Insert):
            return self.insert(s)
        if isinstance(s, N.Update):
            return self.update(s)
        if isinstance(s, N.Delete):
            return self.delete(s)
        if isinstance(s, N.Show):
            return self.show(s)
        if isinstance(s, N.Explain):
            return self.explain(s)
        return self.define(s)

    def explain(self, x: N.Explain) -> DataFrame:
        s = x.statement
        if isinstance(s, N.Delete):
            s = N.Select(s.entity, (), s.where, order=s.order, limit=s.limit, offset=s.offset)
        src = self.source(s.entity)
        text = explain(s, src.schema, run(s, src), x.mode)
        return self.spark.createDataFrame([(text,)], "plan string")

    def query(self, entity: str) -> Query:
        return Query(self, entity)

    def dynamic(self, request: dict[str, Any] | str) -> DataFrame:
        """A query given as data: entity, select, where (SQL text), order ([[field, desc]]), limit, offset."""
        r = json.loads(request) if isinstance(request, str) else request
        unknown = set(r) - {"entity", "select", "where", "order", "limit", "offset", "distinct"}
        if unknown:
            refuse("dynamic_request", f"unknown part {sorted(unknown)[0]}")
        from quillon.plans.sqltext import Parser

        where = Parser(r["where"]).expr() if r.get("where") else None
        items = tuple(N.Item(N.Field(tuple(f.split(".")))) for f in r.get("select", ()))
        order = tuple(N.Order(N.Field(tuple(f.split("."))), bool(d)) for f, d in r.get("order", ()))
        return self.select(N.Select(r["entity"], items, where, bool(r.get("distinct")), order=order, limit=r.get("limit"), offset=r.get("offset")))
