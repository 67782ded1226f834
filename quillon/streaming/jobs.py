"""Resumable work: jobs that keep their progress in numbered files and advance only from what they proved.

There is no event-time streaming to offer; these are the stateful counterparts that the engine has.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import functions as F

from quillon.functions.errors import refuse
from quillon.operators.database import Database
from quillon.operators.mutate import value_of
from quillon.operators.paging import _pack, _unpack, behind
from quillon.plans import nodes as N
from quillon.plans.compile import Scope, boolean
from quillon.plans.select import sort_columns

SCANNED, UPDATED = 4096, 240


class ResumableJob:
    """State under <root>/_jobs/<name>/; advance() succeeds only from the state that the caller has seen."""

    def __init__(self, db: Database, name: str) -> None:
        self.db, self.home = db, f"{db.store.root}/_jobs/{name}"

    def state(self) -> tuple[int, Any]:
        names = [n for n in self.db.store.files.names(self.home) if n.endswith(".json")]
        return (0, None) if not names else (int(names[-1][:8]), json.loads(self.db.store.files.read(f"{self.home}/{names[-1]}")))

    def advance(self, seen: int, state: Any) -> int:
        if not self.db.store.files.create(f"{self.home}/{seen + 1:08d}.json", json.dumps(state)):
            refuse("job_conflict", "the job has moved on")
        return seen + 1

    def run(self, step: Callable[[Any], tuple[Any, bool]], most: int = 1 << 30) -> Any:
        """Applies step to the state until it says done; a rerun goes on where the last one stopped."""
        number, state = self.state()
        for _ in range(most):
            if state is not None and state.get("done"):
                break
            new, done = step(None if state is None else state["value"])
            state = {"value": new, "done": done}
            number = self.advance(number, state)
        return None if state is None else state["value"]


class MutationJob:
    """A durable UPDATE over any number of rows: forward pages in key order, then verifying ones.

    The idempotency key names the job: the same key with another statement is refused. A page scans at most
    SCANNED keys and updates at most UPDATED rows.
    """

    def __init__(self, db: Database, key: str, text: str) -> None:
        s = db.parse(text)
        if not isinstance(s, N.Update) or s.order or s.limit is not None or s.returning is not None:
            refuse("job_statement", "a mutation job takes a plain UPDATE")
        self.db, self.s, self.text, self.job = db, s, text, ResumableJob(db, f"mutation-{key}")

    def step(self, state: dict | None) -> tuple[dict, bool]:
        state = state or {"text": self.text, "phase": "forward", "after": None, "updated": 0, "scanned": 0}
        if state["text"] != self.text:
            refuse("idempotency", "the key belongs to another statement")
        src = self.db.source(self.s.entity)
        scope, schema = Scope(src.schema), src.schema
        terms = [(scope.field((k,)).col, False) for k in schema.key]
        df = src.df if state["after"] is None else src.df.filter(behind(terms, [_unpack(x) for x in state["after"]]))
        hit = boolean(self.s.where, scope) if self.s.where is not None else F.lit(True)
        stale = F.lit(False)
        for name, lit in self.s.sets:
            f = schema.field(name)
            v = value_of(f, (f.default if f.has_default else None) if lit.kind == "default" else lit.value)
            stale = stale | ~F.col(f"`{f.name}`").eqNullSafe(F.lit(v).cast(f.spark_type()))
        page = df.orderBy(*sort_columns(terms)).limit(SCANNED).select(*schema.key, F.coalesce(hit & stale, F.lit(False)).alias("__todo")).collect()
        todo, last = [], None
        for r in page:
            if r["__todo"] and len(todo) == UPDATED:
                break
            last = r
            if r["__todo"]:
                todo.append(r)
        if todo and state["phase"] == "verify":
            refuse("job_verify", "rows have come up that the forward pass didn't reach")
        if todo:
            where = None
            for r in todo:
                one = None
                for k in schema.key:
                    e = N.Binary("=", N.Field((k,)), N.Lit(r[k], "text" if isinstance(r[k], str) else "int"))
                    one = e if one is None else N.Binary("AND", one, e)
                where = one if where is None else N.Binary("OR", where, one)
            if len(schema.key) == 1:
                where = N.InList(N.Field((schema.key[0],)), tuple(N.Lit(r[0], "text" if isinstance(r[0], str) else "int") for r in todo))
            self.db.update(N.Update(self.s.entity, self.s.sets, where), most=UPDATED)
        new = state | {"updated": state["updated"] + len(todo), "scanned": state["scanned"] + (page.index(last) + 1 if last else 0), "after": [_pack(last[k]) for k in schema.key] if last else state["after"]}
        ended = not page or last is page[-1] and len(page) < SCANNED
        if ended and state["phase"] == "forward":
            return new | {"phase": "verify", "after": None}, False
        return new, ended

    def run(self, pages: int = 1 << 30) -> dict:
        """Progress after at most `pages` more pages."""
        return self.job.run(self.step, pages)
