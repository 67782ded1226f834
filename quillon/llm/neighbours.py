"""Embedding near-duplicates through a robust-pruned flat graph over overlapping cluster shards.

1. Equal vectors of a label are one node with a count. Cluster centres come from a bounded sample; every
   node is indexed: it joins the shards of its OVERLAP nearest centres, the nearest is its home.
2. In a shard each node's nearest members are pruned robustly: a candidate goes if a kept neighbour is
   clearly nearer to it than the node is. Adjacency lists of a node are united over its shards.
3. Every node searches the shards of its nearest centres. How many, a label's audit tells: a bounded sample
   is compared with every node of the label, whatever its shard, and MARGIN times as many are searched as
   its furthest link needs, up to all. If the bisectors of the centres prove that fewer shards can be the
   home of a linked node, only these are searched, which loses nothing.
4. A search goes greedily with a beam from the shard's medoid and the node's neighbours, then expands
   everything within reach of the threshold until nothing new turns up. Each shard audits its beam: some
   queries are compared with brute force, and where one misses a link the shard searches again with twice
   the beam, at last through all members.
5. What is found is verified by the exact cosine. A link counts in the first searched shard that holds its
   other end, and for that end too if it doesn't search a shard that holds the first. Only a spanning forest
   of the links leaves the shard, so a dense group never becomes all its pairs.

Shards of more than MAX_SHARD members are split into blocks; a shard's queries go to each of its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import mapped, staged, table
from quillon.llm.grouped import by_group, components

#: Bound of the sample that centres are fit on, so of what is broadcast; members aimed at in a shard.
MAX_SAMPLE, SHARD, MAX_SHARD, OVERLAP = 8192, 256, 2048, 3
DEGREE, NEAREST, ALPHA, BEAM, AUDITED = 24, 48, 1.2, 24, 8
#: Nodes that are compared with all others of their label, and how often the shards that their links need are searched.
SAMPLED, MARGIN = 2048, 2
#: Below the threshold by this much a node is still expanded.
SLACK = 0.12


def fit_centres(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k centres on the unit sphere, by Lloyd's steps from the first k rows of the sample."""
    c = sample[:k].copy()
    for _ in range(rounds):
        near = (sample @ c.T).argmax(1)
        for i in range(len(c)):
            if (mine := sample[near == i]).size and (s := np.linalg.norm(m := mine.mean(0))) > 0:
                c[i] = m / s
    return c


def ranked(units: np.ndarray, centres: np.ndarray | None) -> np.ndarray:
    """The centres of each row, the nearest first; one shard where a label has no centres."""
    if centres is None:
        return np.zeros((len(units), 1), np.int64)
    return np.argsort(-(units @ centres.T), axis=1, kind="stable")


def searched(unit: np.ndarray, order: np.ndarray, centres: np.ndarray | None, many: int, threshold: float) -> np.ndarray:
    """The centres whose shards a vector searches, of its centres in their order: the first `many`, or, if
    they are no more, all that can be the nearest centre of a vector within the threshold.

    Such a vector lies on the other side of the bisector of that centre and the first one, so the sine of
    the angle to the bisector is at most that of the threshold.
    """
    if centres is None or threshold < 0:
        return order
    gap, sim = np.linalg.norm(centres[order] - centres[order[0]], axis=1), centres[order] @ unit
    able = order[sim[0] - sim <= np.sqrt(max(0.0, 1 - threshold * threshold)) * gap + 1e-9]
    return able if len(able) <= many else order[:many]


def robust_prune(sim: np.ndarray) -> list[np.ndarray]:
    """Neighbours of each row of a similarity matrix of unit vectors."""
    n = len(sim)
    dist = np.sqrt(np.maximum(0.0, 2 - 2 * sim))
    np.fill_diagonal(dist, np.inf)
    k = min(NEAREST, n - 1)
    if k <= 0:
        return [np.zeros(0, np.int64) for _ in range(n)]
    near = np.argpartition(dist, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.take_along_axis(dist, near, 1).argsort(1, kind="stable"), 1)
    own = np.take_along_axis(dist, near, 1)
    alive, kept = np.ones((n, k), bool), np.zeros((n, k), bool)
    for j in range(k):
        take = alive[:, j] & (kept.sum(1) < DEGREE)
        kept[:, j] = take
        alive[:, j] = False
        alive &= ~(take[:, None] & (ALPHA * dist[near[:, j][:, None], near] <= own))
    return [near[i, kept[i]] for i in range(n)]


def _build(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """Undirected adjacency of one shard's members."""
    node = group["node"].to_numpy()
    v = np.stack([np.frombuffer(x.as_py(), np.float64) for x in group["unit"]])
    near = robust_prune(v @ v.T)
    both = [set(x.tolist()) for x in near]
    for i, x in enumerate(near):
        for j in x.tolist():
            both[j].add(i)
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([node[sorted(x)] for x in both], pa.list_(pa.int64()))], ["node", "near"])


def _search(threshold: float):
    def work(group: pa.Table) -> Iterator[pa.RecordBatch]:
        node, member = group["node"].to_numpy(), group["member"].to_numpy(zero_copy_only=False).astype(bool)
        unit = np.stack([np.frombuffer(x.as_py(), np.float64) for x in group["unit"]])
        mine, queries = np.flatnonzero(member), np.flatnonzero(group["query"].to_numpy(zero_copy_only=False).astype(bool))
        count = group["times"].to_numpy()
        v, ids, times = unit[mine], node[mine], count[mine]
        at = {int(x): i for i, x in enumerate(ids)}
        clusters = np.array([(x.as_py() * OVERLAP)[:OVERLAP] for x in group["clusters"]])
        probes = [np.array(x.as_py()) for x in group["probes"]]
        wide = np.full((len(mine), max(map(len, probes))), -1)
        for i, j in enumerate(mine):
            wide[i, : len(probes[j])] = probes[j]
        here = group["cluster"][0].as_py()
        lists = [np.array([at[y] for y in (x.as_py() or ()) if y in at], np.int64) for x in group["near"]]
        graph = [lists[j] for j in mine]
        n = len(v)
        if not n or not len(queries):
            return
        medoid = int((v @ v.mean(0)).argmax())

        def found(j: int, beam: int) -> np.ndarray:
            """Members linked to row j, itself apart."""
            q, self_at = unit[j], at.get(int(node[j]), -1)
            if beam >= n:
                sim = v @ q
            else:
                sim, open_ = np.full(n, -2.0), np.zeros(n, bool)
                new = np.unique(np.append(lists[j], medoid))
                while len(new):
                    sim[new] = v[new] @ q
                    open_[new] = True
                    seen = np.flatnonzero(sim > -2)
                    if len(seen) > beam:
                        seen = seen[np.argpartition(-sim[seen], beam - 1)[:beam]]
                    step = seen[open_[seen]]
                    reach = np.flatnonzero(open_ & (sim >= threshold - SLACK))
                    step = np.union1d(step[np.argsort(-sim[step])[:4]], reach)
                    if not len(step):
                        break
                    open_[step] = False
                    new = np.unique(np.concatenate([graph[i] for i in step]))
                    new = new[sim[new] <= -2]
                    if not len(new):
                        new = seen[:0]
                        if open_[seen].any():
                            new = seen[open_[seen]][:1]
            hit = np.flatnonzero(sim >= threshold)
            return hit[hit != self_at]

        beam, audited = BEAM, queries[np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int)]
        truth = {j: {i for i in np.flatnonzero(v @ unit[j] >= threshold).tolist() if ids[i] != node[j]} for j in audited}
        while beam < n and any(truth[j] - set(found(j, beam).tolist()) for j in audited):
            beam *= 2
        comp, out = np.arange(n), []
        for j in queries:
            hit = found(j, beam)
            before = probes[j][: int(np.flatnonzero(probes[j] == here)[0])]
            new = hit[~np.isin(clusters[mine[hit]], before).any(1)]
            out.append((int(node[j]), int(times[new].sum()), None))
            one_way = new[~np.isin(wide[new], clusters[j]).any(1)]
            out += [(int(ids[i]), int(count[j]), None) for i in one_way]
            if (own := at.get(int(node[j]))) is None:
                marks = np.unique(comp[hit], return_index=True)[1]
                out += [(int(node[j]), 0, int(ids[hit[i]])) for i in marks]
                if len(hit):
                    comp[np.isin(comp, comp[hit])] = comp[hit[0]]
            elif len(hit):
                for i in hit[np.unique(comp[hit], return_index=True)[1]]:
                    if comp[i] != comp[own]:
                        out.append((int(node[j]), 0, int(ids[i])))
                        comp[comp == comp[i]] = comp[own]
        a, b, c = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["node", "links", "other"])

    return work


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector scaled to length 1 in double precision, or null where it can't link."""
    for b in batches:
        out = []
        for x in b.column(2):
            y = None if (y := x.as_py()) is None or any(e is None for e in y) else np.array(y, np.float64)
            ok = y is not None and len(y) and np.isfinite(y).all() and np.abs(y).max() > 0
            if ok:
                y = y / np.abs(y).max()
                y = y / np.sqrt(y @ y)
            out.append(y.tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["id", "label", "unit"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93) -> DataFrame:
    """id (long), n_links long, component_id long, kept boolean of every row.

    Rows link when their labels are equal and not null and their cosine is at least the threshold.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do
    those of different lengths. Repeated rows count each other. A null id stays null, its kept too.
    An empty table gives an empty result; other columns stay out, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].alias("v"))
    rows = staged(rows.transform(mapped, _units, "id long, label string, unit binary"), "vectors")
    good = rows.filter("unit is not null and label is not null")
    nodes = good.withColumn("label", F.concat(F.octet_length("unit").cast("string"), F.lit(":"), "label")).groupBy("label", "unit").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("times"))
    nodes = staged(nodes.withColumn("node", F.coalesce("rep", -F.abs(F.shiftright(F.xxhash64("label", "unit"), 1)) - 2)), "vector-nodes")
    total = nodes.count()
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(MAX_SAMPLE).select("label", "unit", "node").toPandas()
    centres = {}
    for label, part in sample.groupby("label", sort=True):
        x = np.stack([np.frombuffer(u, np.float64) for u in part.unit])
        centres[label] = fit_centres(x, max(1, min(len(x) // 4, round(len(x) / len(sample) * total / SHARD))))
    audited = {}
    for label, part in sample[:SAMPLED].groupby("label", sort=True):
        x = np.stack([np.frombuffer(u, np.float64) for u in part.unit])
        audited[label] = part.node.to_numpy(), x, ranked(x, centres[label]).argsort(axis=1).astype(np.int16)
    shared, probed = spark.sparkContext.broadcast(centres), spark.sparkContext.broadcast(audited)

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many of the audited links need how many shards, by label."""
        sums: dict[tuple[str, int], int] = {}
        for b in batches:
            labels = np.array(b.column(0).to_pylist(), object)
            for label in set(labels) & probed.value.keys():
                at = np.flatnonzero(labels == label)
                node, x, rank = probed.value[label]
                u = np.stack([np.frombuffer(b.column(1)[int(i)].as_py(), np.float64) for i in at])
                own = b.column(2).to_numpy()[at]
                i, j = np.nonzero((u @ x.T >= threshold) & (own[:, None] != node))
                near = ranked(u, shared.value[label])[:, :OVERLAP]
                for need, n in zip(*np.unique(rank[j[:, None], near[i]].min(1), return_counts=True), strict=True):
                    sums[label, int(need) + 1] = sums.get((label, int(need) + 1), 0) + int(n)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums], pa.int32()), pa.array(list(sums.values()), pa.int64())], ["label", "need", "n"])

    most = {r.label: r.need for r in nodes.select("label", "unit", "node").transform(mapped, needs, "label string, need int, n long").groupBy("label").agg(F.max("need").alias("need")).collect()}
    many = {label: max(OVERLAP, MARGIN * most.get(label, 1)) for label in centres}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, cluster, near, probes = [], [], [], []
            for i, (label, unit) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                c, x = shared.value.get(label), np.frombuffer(unit.as_py(), np.float64)
                order = ranked(x[None], c)[0]
                ask = searched(x, order, c, many.get(label, 1), threshold).tolist()
                own = order[:OVERLAP].tolist()
                both = list(dict.fromkeys(own + ask))
                take += [i] * len(both)
                cluster += both
                near += [own] * len(both)
                probes += [ask] * len(both)
            some = b.take(pa.array(take, pa.int32()))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cluster, pa.int32()), pa.array(near, ints), pa.array(probes, ints)], ["label", "unit", "node", "times", "cluster", "clusters", "probes"])

    placed = staged(nodes.select("label", "unit", "node", "times").transform(mapped, assign, "label string, unit binary, node long, times long, cluster int, clusters array<int>, probes array<int>"), "vector-shards")
    placed = placed.withColumn("member", F.array_contains("clusters", F.col("cluster"))).withColumn("query", F.array_contains("probes", F.col("cluster")))
    sizes = placed.filter("member").groupBy("label", "cluster").agg(F.ceil(F.count(F.lit(1)) / MAX_SHARD).cast("long").alias("blocks"))
    placed = placed.join(sizes, ["label", "cluster"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    members = placed.filter("member").withColumn("shard", F.xxhash64("label", "cluster", "block"))
    near = staged(by_group(members.select("shard", "node", "unit"), "shard", _build, "node long, near array<long>"), "vector-lists")
    united = near.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # OVERLAP lists at most
    asked = placed.select("*", F.explode(F.when(F.col("query"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("block"))).alias("to"))
    asked = asked.select(F.xxhash64("label", "cluster", "to").alias("shard"), "node", "unit", "times", "cluster", "clusters", "probes", (F.col("member") & (F.col("to") == F.col("block"))).alias("member"), "query").join(united, "node", "left")
    found = staged(by_group(asked, "shard", _search(threshold), "node long, links long, other long"), "vector-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), "vector-round")
    known = nodes.select("node", "label", "unit", "times", "rep").join(counts, "node", "left").join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("rep").alias("least"))
    known = known.join(least, "component").select("label", "unit", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "least")
    keyed = rows.withColumn("key", F.when(F.col("unit").isNotNull() & F.col("label").isNotNull(), F.concat(F.octet_length("unit").cast("string"), F.lit(":"), "label")))
    out = keyed.drop("label").join(known, (keyed.key == known.label) & (keyed.unit == known.unit), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("links").isNotNull(), F.col("least")).otherwise(F.col("id")).alias("component_id")).withColumn("kept", F.col(id_col) == F.col("component_id"))


def recall(vectors: DataFrame, found: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, every: int = 100) -> DataFrame:
    """expected and found numbers of links of the queries, the rows whose id `every` divides, by brute
    force against all rows; the queries go along in blocks of 1,024."""
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[label_col].cast("string").alias("label"), vectors[vector_col].alias("v")).transform(mapped, _units, "id long, label string, unit binary").filter("unit is not null and label is not null and id is not null")
    queries = rows.filter(F.col("id") % every == 0).withColumn("block", F.floor(F.row_number().over(Window.orderBy("id")) / 1024)).toPandas()
    parts = []
    for _, q in queries.groupby(["block", queries.unit.map(len)]):
        ids, labels, units = q.id.to_numpy(), q.label.to_numpy(), np.stack([np.frombuffer(u, np.float64) for u in q.unit])

        def compare(batches, ids=ids, labels=labels, units=units):
            for b in batches:
                n = np.zeros(len(ids), np.int64)
                for i, label, unit in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    if len(unit.as_py()) == 8 * units.shape[1]:
                        n += (labels == label) & (ids != i) & (units @ np.frombuffer(unit.as_py(), np.float64) >= threshold)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["id", "n"])

        parts.append(rows.transform(mapped, compare, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")))
    if not parts:
        return spark.createDataFrame([(0, 0)], "expected long, found long")
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.join(found.select(F.col(id_col).alias("id"), "n_links"), "id").agg(F.sum("n").alias("expected"), F.sum(F.least("n", "n_links")).alias("found"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of embeddings, at a cosine of 0.93."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT vec_id, label, [x / sqrt(list_dot_product(e, e)) FOR x IN e] AS e FROM v
      WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND list_dot_product(e, e) > 0),
p AS (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_dot_product(x.e, y.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a),
n AS (SELECT a, count(*) AS k FROM p GROUP BY a)
SELECT embeddings.vec_id, coalesce(n.k, 0)::BIGINT AS n_links, c.m AS component_id, c.m = embeddings.vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
