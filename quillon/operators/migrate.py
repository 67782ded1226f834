"""Schema migrations: adjacent versions, applied to files in bounded steps and committed at once.

A migration says which schema version it starts from, the fields that it gives the entity, and SQL expressions
for those whose values change. Files are rewritten a few at a time; progress is kept as a resumable job's, so
that a rerun goes on with the files that are left. Readers see the old version until the one commit.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from quillon.functions.errors import refuse
from quillon.functions.schema import EntitySchema, FieldSpec
from quillon.plans.compile import Scope, typed
from quillon.plans.sqltext import Parser

FILES_AT_A_TIME = 64


@dataclass(frozen=True)
class Migration:
    start: int
    fields: tuple[FieldSpec, ...]
    values: dict[str, str] = field(default_factory=dict, hash=False)  # field: expression over the old fields
    renames: dict[str, str] = field(default_factory=dict, hash=False)  # new name: old name


class Migrations:
    """Mixed into Database."""

    def _migrated(self, old: EntitySchema, new: EntitySchema, m: Migration, rows: DataFrame) -> DataFrame:
        scope, cols = Scope(old), []
        names = {f.name for f in old.fields}
        for f in new.fields:
            source = m.renames.get(f.name, f.name)
            if f.name in m.values:
                c = typed(Parser(m.values[f.name]).expr(), scope).col
            elif source in names:
                c = scope.field((source,)).col
            elif f.has_default or f.nullable:
                from pyspark.sql import functions as F

                c = F.lit(f.default if f.has_default else None)
            else:
                refuse("migration", f"{f.name} has neither value nor default")
            cols.append(c.cast(f.spark_type()).alias(f.name))
        return rows.select(*cols)

    def migrate(self, entity: str, migrations: list[Migration]) -> int:
        """Applies what starts at the entity's version or later, in order; returns the version reached."""
        from quillon.operators.mutate import settle, broken, violations  # noqa: I001
        from quillon.streaming.jobs import ResumableJob

        for m in sorted(migrations, key=lambda m: m.start):
            snap = self.snapshot(entity)
            if m.start < snap.schema.version:
                continue
            if m.start > snap.schema.version:
                refuse("migration_gap", f"{entity} is at version {snap.schema.version}, the next migration starts at {m.start}")
            fields = tuple(replace(f, source=None, since=0, added_default=None) for f in m.fields)
            new = snap.schema.changed(fields=fields)
            mark = hashlib.sha256(f"{new.to_json()}{sorted(m.values.items())}{snap.number}".encode()).hexdigest()[:16]
            job = ResumableJob(self, f"migration-{entity}-{m.start}-{mark}")

            def step(state: list | None, snap=snap, new=new, m=m) -> tuple[list, bool]:
                done, out = state or [0, []]
                part = snap.files[done : done + FILES_AT_A_TIME]
                if part:
                    rows = self._migrated(snap.schema, new, m, self.store.read(snap, part))
                    settle(broken(rows, violations(new, list(new.checks))))
                    out = out + list(self.store.write(new, rows, snap.number + 1))
                return [done + len(part), out], done + len(part) >= len(snap.files)

            _, files = job.run(step)
            made = self.store.read(replace(snap, schema=new, files=tuple(files)))
            settle(self._unique(new, None, made) + self._relations(new, made, {entity.lower(): made}))
            self.store.commit(new, snap.number + 1, tuple(files), snap.sequence)
        return self.snapshot(entity).schema.version
