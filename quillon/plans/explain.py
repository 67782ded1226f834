"""EXPLAIN: the logical steps, as text or JSON, with Spark's formatted plan behind EXECUTION and VERBOSE."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from quillon.functions.schema import EntitySchema
from quillon.plans import nodes as N
from quillon.plans.admission import access, sorts
from quillon.plans.select import fingerprint, lane, output_name, render


def steps(s: N.Select, schema: EntitySchema) -> list[dict]:
    kind, keys = access(s, schema)
    out: list[dict] = [{"node": "access", "kind": kind, "entity": schema.name, "keys": list(keys)}]
    which = lane(s)
    windowed = s.limit is not None or bool(s.offset)
    order = {"node": "sort" if sorts(s, schema) else "ordered_access", "terms": [f"{render(o.expr)} {'DESC' if o.desc else 'ASC'}" for o in s.order] + [f"{k} ASC" for k in schema.key]}
    if s.where is not None:
        out.append({"node": "filter", "predicate": render(s.where)})
    if which == "global" and windowed:
        out += [order, {"node": "window", "limit": s.limit, "offset": s.offset or 0}]
    if which == "grouped":
        out.append({"node": "group", "keys": [render(g) for g in s.group]})
    if which != "scalar":
        out.append({"node": "aggregate", "terms": [render(i.expr) for i in s.items if N.has_aggregate(i.expr)]})
    if s.having is not None:
        out.append({"node": "having", "predicate": render(s.having)})
    if which == "scalar" and not s.distinct and (s.order or windowed):
        out.append(order | ({"node": "top_n", "keep": (s.limit or 0) + (s.offset or 0)} if s.limit is not None and order["node"] == "sort" else {}))
    out.append({"node": "project", "outputs": [output_name(i) for i in s.items] or [f.name for f in schema.fields]})
    if s.distinct and which == "scalar":
        out.append({"node": "distinct"})
    if which == "grouped" and s.order:
        out.append({"node": "top_k" if s.limit is not None else "sort", "terms": [render(o.expr) for o in s.order]})
    if windowed and which != "global":
        out.append({"node": "window", "limit": s.limit, "offset": s.offset or 0})
    return out


def explain(s: N.Select, schema: EntitySchema, df: DataFrame, mode: str) -> str:
    plan = {"lane": lane(s), "fingerprint": fingerprint(s, schema), "steps": steps(s, schema)}
    if mode == "JSON":
        return json.dumps(plan, default=str)
    lines = [f"lane: {plan['lane']}"] + [f"{'  ' * i}{d['node']}" + "".join(f" {k}={v}" for k, v in d.items() if k != "node" and v not in ([], None)) for i, d in enumerate(reversed(plan["steps"]))]
    if mode in ("VERBOSE", "EXECUTION"):
        lines.append(f"fingerprint: {plan['fingerprint']}")
        lines.append(df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted"))
    return "\n".join(lines)
