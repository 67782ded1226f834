"""N-gram Jaccard join through a token-group matrix.

Documents with equal shingle sets are one set. Similar sets share a group: the sets of one least
shingle hash, and those of a smaller group that have most of their tokens in common with it (split into
blocks of MAX_GROUP sets, so that no group grows without bound).

The matrix's tokens make every bound exact without frequent tokens. Shingles are dealt into m parts by
hash, and a token is the content of one part. If 100 * |A and B| >= t * |A or B|, A and B differ in
d <= (100 - t) / (100 + t) * (|A| + |B|) shingles, so in at most d parts, so they share at least m - d
tokens. m depends on a size class; a set of a size near a class's upper end has tokens of the next
class too. Parts of a single shingle make no tokens, and count against the bound; the few sets that are
left without a bound also have prefix tokens. A row of the matrix is a group that holds a token in its
union. With a bound of b, two linked sets have in common one of the tokens that are left of either when its b - 1
most frequent ones are set aside, for else fewer than b would be common; so only these ask and answer, and a
group is opened for a set that has one of them in the group's union. A set with fewer than b tokens in
common with any other opens nothing. A passage that many documents share is in parts with each document's own
shingles, or in their most frequent tokens, so it makes no pairs.

Of two groups the smaller one's sets are the queries. A token's groups first ask only the largest of them; then, of
the groups whose sets aren't all connected yet, each asks each other one that shares a token with it. An opened group's sets are compared exactly, by
walking from each set to those not reached yet: links come out as a spanning forest, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import discard, mapped, staged, table, tasks
from quillon.llm.grouped import by_group, components

#: Ratio of a size class; more sets than this in a group are split into blocks.
CLASS_RATIO, MAX_GROUP = 1.35, 4096
#: Parts beyond the least number, by the square of the dissimilarity; shingles of a light part.
SPARE, LIGHT = 20, 1
#: Tokens that a larger group must share for a set to move there, as a share of the most differences.
MOVE = 0.15


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of word shingles of the ASCII-lower-cased text; fewer words make one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    x = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        x = (x ^ h[k : n - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
    return np.unique(x)


def most_different(a: int, b: float, percent: int) -> int:
    """The most shingles in which linked sets of sizes a and b differ."""
    return int((100 - percent) * (a + b) / (100 + percent) + 1e-9)


def size_class(n: int) -> int:
    return int(np.log(n) / np.log(CLASS_RATIO) + 1e-9)


def parts_of(k: int, percent: int) -> int:
    """Parts of size class k: over the most differences of two sets in it, by more the lower the similarity."""
    top = CLASS_RATIO ** (k + 1)
    return int((1 + SPARE * (1 - percent / 100) ** 2) * most_different(int(top), top, percent)) + 1


def tokens(sets: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """(tokens that any linked set shares at least, tokens) of a set, for its class and, near its end, the next ones up to that of the largest linked set.

    Parts of at most LIGHT shingles are left out, as unrelated sets share them often; the bound falls by
    their number. A set for which it would fall below 1 also has its prefix as tokens: the shingles of the
    least hashes, so many that two linked sets share one. A set that keeps its bound shares a token of a
    part with any linked set, so prefixes are only needed between two sets that both have them.
    """
    n, least, out = len(sets), 1 << 30, []
    if not n:
        return 0, sets
    most = most_different(n, n * 100 // percent, percent)
    for k in range(size_class(n), size_class(max(n, n * 100 // percent)) + 1):
        m = parts_of(k, percent)
        part = ((sets >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(m + 1))
        mixed = sets * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(31)
        # a sum of mixed hashes names a part's content
        total = np.append(np.uint64(0), np.cumsum(mixed[order] * np.uint64(0x165667B19E3779F9), dtype=np.uint64))
        x = total[bounds[1:]] - total[bounds[:-1]]
        x = (x + np.arange(m, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((k + 1) * 0xD6E8FEB86659FD93 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(33)
        heavy = np.diff(bounds) > LIGHT
        out.append(x[heavy])
        least = min(least, m - most - int((~heavy).sum()))
    if least < 1:
        first = sets[: n - -(-n * percent // 100) + 1]
        out.append((first ^ np.uint64(0xA0761D6478BD642F)) * np.uint64(0xE7037ED1A0B428DB))
    return max(1, least), np.concatenate(out)


def _links(near: np.ndarray, size: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which sets link with one of `size` shingles, given how many shingles each has in common with it."""
    return 100 * near >= percent * (size + sizes - near)


class _Group:
    """One group's members, and the spanning links of queries with them."""

    def __init__(self, node: np.ndarray, sets: list[np.ndarray], tree: np.ndarray, percent: int) -> None:
        self.node, self.sets, self.percent = node, sets, percent
        self.sizes = np.array([len(x) for x in sets])
        owner, flat = np.repeat(np.arange(len(sets)), self.sizes), np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]
        self.tree = tree

    def linked(self, x: np.ndarray) -> np.ndarray:
        first, last = np.searchsorted(self.flat, x, "left"), np.searchsorted(self.flat, x, "right")
        k = last - first
        spots = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first, k)
        return _links(np.bincount(self.owner[spots], minlength=len(self.sets)), len(x), self.sizes, self.percent)

    def inside(self) -> list[tuple[int, int]]:
        """A spanning forest of the members' links, by walking from each set to those not reached yet."""
        out, free = [], np.ones(len(self.sets), bool)
        for root in range(len(self.sets)):
            if not free[root]:
                continue
            free[root], self.tree[root], walk = False, root, [root]
            while walk and free.any():
                i = walk.pop()
                found = np.flatnonzero(free & self.linked(self.sets[i]))
                free[found], self.tree[found] = False, root
                walk += found.tolist()
                out += [(int(self.node[i]), j) for j in self.node[found].tolist()]
        return out

    def asked(self, node: int, x: np.ndarray) -> list[tuple[int, int]]:
        """One link of a query to each tree of members that it links with."""
        found = np.flatnonzero(self.linked(x))
        return [(node, int(self.node[i])) for i in dict(zip(self.tree[found].tolist(), found.tolist(), strict=True)).values()]


def _open(percent: int, width: int, again: bool):
    """Links of groups: a group's members are held, its queries, which come after them, pass by. The members' own
    links are looked for unless groups are opened again; then `tree` has the components known so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        key, node, sets, trees, group = None, [], [], [], None

        def edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["a", "b"])

        def held() -> tuple[_Group, list[tuple[int, int]]]:
            made = _Group(np.array(node, np.int64), sets, np.array(trees, np.int64), percent)
            return made, [] if again else made.inside()

        for b in batches:
            rows: list[tuple[int, int]] = []
            for n, z, grp, query, tree in zip(b.column("node").to_pylist(), b.column("z"), *(b.column(c).to_pylist() for c in ("grp", "query", "tree")), strict=True):
                if grp != key:
                    if key is not None and group is None:
                        rows += held()[1]
                    key, node, sets, trees, group = grp, [], [], [], None
                x = shingles(press.decompress(z.as_py()).decode("utf-8", "surrogatepass"), width)
                if not query:
                    node.append(n)
                    sets.append(x)
                    trees.append(tree)
                    continue
                if group is None:
                    group, more = held()
                    rows += more
                rows += group.asked(n, x)
            yield edges(rows)
        if key is not None and group is None:
            yield edges(held()[1])

    return run


def _qualifying(pairs: pa.Table) -> Iterator[pa.RecordBatch]:
    """The sets of one group that open another; a row of pairs is a token of both, with the first one's sets."""
    able = np.unique(pairs["asking"].combine_chunks().flatten().to_numpy())
    yield pa.RecordBatch.from_arrays([pa.array(able, pa.int64()), pa.array(np.full(len(able), pairs["other"][0].as_py()), pa.int64())], ["node", "grp"])


def _compare(texts: DataFrame, nodes: DataFrame, members: DataFrame, queries: DataFrame, percent: int, width: int, again: bool = False) -> DataFrame:
    """a, b: spanning links inside groups (node, grp, tree of members) and of queries (node, grp) with them."""
    to = members.withColumn("query", F.lit(False)).unionByName(queries.withColumns({"query": F.lit(True), "tree": F.lit(0).cast("long")}))
    deliver = to.groupBy("node").agg(F.collect_list(F.struct("grp", "query", "tree")).alias("to")).join(nodes.select("node", "s1", "s2", "rep"), "node")
    deliver = staged(deliver, "jaccard-deliver")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for big in batches:
            for i in range(0, big.num_rows, 500):
                b = big.slice(i, 500)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([press.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in b.column(1)], pa.binary())], ["id", "z"])

    packed = texts.filter("id is not null").transform(mapped, pack, "id long, z binary")
    # one plan at every size: the list of sets to deliver has no bound, so it isn't broadcast where it happens to be small
    plain = packed.join(deliver.filter("rep is not null").select("rep", "node", "to").hint("merge"), F.col("id") == F.col("rep")).select("node", "to", "z")
    if not nodes.filter("rep is null").isEmpty():  # sets whose rows have no id are found by their contents

        def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            press = zstandard.ZstdCompressor(level=1)
            for b in batches:
                raw = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column(0)]
                names = [xxhash.xxh3_128_intdigest(shingles(t.as_py(), width).tobytes()) for t in b.column(0)]
                longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([press.compress(x) for x in raw], pa.binary()), longs([x & (2**64 - 1) for x in names]), longs([x >> 64 for x in names])], ["z", "s1", "s2"])

        named = texts.filter("id is null").select("text").transform(mapped, name, "z binary, s1 long, s2 long")
        plain = plain.unionByName(named.join(deliver.filter("rep is null").select("s1", "s2", "node", "to"), ["s1", "s2"]).select("node", "to", "z"))
    sent = plain.select("node", "z", F.explode("to").alias("x")).select("node", "z", "x.*")
    dealt = sent.repartition(tasks(sent.sparkSession, 12), "grp").sortWithinPartitions("grp", "query")
    return dealt.transform(mapped, _open(percent, width, again), "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """id (long), n_shingles long, component_id long of every row whose Jaccard similarity links reach.

    Two rows link when 100 * intersection >= percent * union of their shingle sets. Null, empty and
    wordless texts have 0 shingles and stay alone. Rows that repeat an id or a text get a row each; rows of
    one id count as linked. A null id stays null; its component is the least id that it reaches, if any. An
    empty table gives an empty result; other columns stay out, whatever their names.
    """

    longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, big.num_rows, 500):
                b = big.slice(start, 500)
                sets = [shingles(t.as_py(), width) for t in b.column(1)]
                names = [xxhash.xxh3_128_intdigest(x.tobytes()) for x in sets]
                needs = [tokens(x, percent)[0] for x in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int64()), longs([x & (2**64 - 1) for x in names]), longs([x >> 64 for x in names]), longs([x[0] if len(x) else 0 for x in sets]), pa.array(needs, pa.int64())], ["id", "n", "s1", "s2", "least", "need"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for big in batches:
            for start in range(0, big.num_rows, 500):
                flat, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
                for t in big.slice(start, 500).column(0):
                    x = shingles(t.as_py(), width)
                    s1 = xxhash.xxh3_128_intdigest(x.tobytes()) & (2**64 - 1)
                    if len(x) and s1 not in seen:
                        seen.add(s1)
                        flat.append(tokens(x, percent)[1])
                        owner.append(np.full(len(flat[-1]), s1, np.uint64))
                yield pa.RecordBatch.from_arrays([longs(np.concatenate(flat)), longs(np.concatenate(owner))], ["token", "s1"])

    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    slim = staged(texts.transform(mapped, read, "id long, n long, s1 long, s2 long, least long, need long"), "jaccard-sets")
    # one node for each distinct set: its least id, or a negative mark if none of its rows has an id
    nodes = slim.filter("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("least").alias("least"), F.first("need").alias("need"))
    nodes = nodes.select("s1", "s2", "n", "least", "need", "rep", F.coalesce("rep", -F.abs(F.shiftright("s1", 1)) - 2).alias("node"))
    sizes = nodes.groupBy("least").agg(F.count(F.lit(1)).alias("sets"))
    nodes = staged(nodes.join(sizes, "least"), "jaccard-nodes")
    # tokens that two sets share; most tokens are in one set alone
    same = Window.partitionBy("token")
    cells = texts.select("text").transform(mapped, spread, "token long, s1 long")
    cells = cells.withColumns({"low": F.min("s1").over(same), "high": F.max("s1").over(same)}).filter("low <> high").select("token", "s1").distinct()
    cells = once = staged(cells.join(nodes.select("s1", "node"), "s1").select("token", "node"), "jaccard-cells")
    # a set whose least shingle is its own moves to the larger group that holds most of its tokens, counting
    # for each token only the largest group: one row for each cell
    info = cells.join(nodes.select("node", "n", F.col("least").alias("grp"), "sets"), "node")
    largest = info.groupBy("token").agg(F.max(F.struct("sets", "grp")).alias("top")).select("token", F.col("top.sets").alias("other_sets"), F.col("top.grp").alias("other"))
    moves = info.join(largest, "token").filter("other_sets > sets").groupBy("node", "n", "other").agg(F.count(F.lit(1)).alias("c"))
    moves = moves.filter(F.col("c") >= MOVE * (100 - percent) / 100 * F.col("n")).groupBy("node").agg(F.max(F.struct("c", "other")).alias("to")).select("node", F.col("to.other").alias("to"))
    placed = nodes.select("node", "need", "least").join(moves, "node", "left").withColumn("family", F.coalesce("to", "least"))
    sizes = placed.groupBy("family").agg(F.count(F.lit(1)).alias("sets"))
    placed = placed.join(sizes, "family").withColumn("grp", F.xxhash64("family", F.pmod(F.xxhash64("node"), F.ceil(F.col("sets") / MAX_GROUP).cast("long"))))
    placed = staged(placed.select("node", "need", "grp", "sets"), "jaccard-groups")
    # of each set's tokens its `need` - 1 most frequent ones are set aside
    holders = cells.groupBy("token").agg(F.count(F.lit(1)).alias("holders"))
    own = Window.partitionBy("node")
    cells = cells.join(holders.hint("merge"), "token").join(placed.hint("merge"), "node")
    cells = cells.withColumns({"held": F.count(F.lit(1)).over(own), "at": F.row_number().over(own.orderBy("holders", "token"))}).filter("at <= held - need + 1")
    between = cells.groupBy("token").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).filter("low <> high").select("token")
    cells = staged(cells.join(between, "token"), "jaccard-between")
    discard(once)
    once, cells = cells, cells.select("token", "node", "grp", "sets")
    # a cell of the matrix is a token of a group, with its sets that have it (MAX_GROUP at most): groups meet at a
    # token once, however many sets each has
    pair = F.struct("sets", "grp") < F.struct(F.col("other_sets").alias("sets"), F.col("other").alias("grp"))

    def ask(asked: DataFrame, label: str) -> DataFrame:
        asked = asked.filter(pair).select(F.xxhash64("grp", "other").alias("pair"), "other", "asking")
        return staged(by_group(asked, "pair", _qualifying, "node long, grp long"), label)

    matrix = staged(cells.groupBy("token", "grp").agg(F.first("sets").alias("sets"), F.collect_list("node").alias("asking")), "jaccard-matrix")
    largest = matrix.groupBy("token").agg(F.max(F.struct("sets", "grp")).alias("top")).select("token", F.col("top.sets").alias("other_sets"), F.col("top.grp").alias("other"))
    opened = ask(matrix.join(largest.hint("merge"), "token"), "jaccard-opened")
    discard(matrix)
    used = opened.select("grp").distinct().withColumn("used", F.lit(True))
    members = placed.join(used, "grp", "left").filter((F.col("sets") > 1) | F.col("used")).select("node", "grp", F.col("node").alias("tree"))
    edges = staged(_compare(texts, nodes, members, opened, percent, width), "jaccard-links")
    reached = staged(components(edges, "jaccard-round"), "jaccard-reached").select("node", F.col("component").alias("tree"))
    cells = cells.join(reached, "node", "left").withColumn("tree", F.coalesce("tree", "node"))
    apart = cells.groupBy("token").agg(F.min("tree").alias("low"), F.max("tree").alias("high")).filter("low <> high").select("token")
    cells = cells.join(apart.hint("merge"), "token")
    matrix = staged(cells.groupBy("token", "grp").agg(F.first("sets").alias("sets"), F.min("tree").alias("low"), F.max("tree").alias("high"), F.collect_list("node").alias("asking")), "jaccard-rest")
    others = matrix.select("token", F.col("grp").alias("other"), F.col("sets").alias("other_sets"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    one = (F.col("low") == F.col("high")) & (F.col("other_low") == F.col("other_high")) & (F.col("low") == F.col("other_low"))
    opened = ask(matrix.join(others.hint("merge"), "token").filter(~one), "jaccard-opened-again")
    discard(matrix, once)
    members = placed.join(opened.select("grp").distinct(), "grp", "left_semi").select("node", "grp").join(reached, "node", "left").withColumn("tree", F.coalesce("tree", "node"))
    more = _compare(texts, nodes, members, opened, percent, width, again=True)
    edges = staged(edges.unionByName(more), "jaccard-all-links")
    reached = components(edges, "jaccard-round")
    found = nodes.select("s1", "s2", "node", "rep").join(reached, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = found.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = found.join(least, "component").select("s1", "s2", "component_id")
    return slim.join(found, ["s1", "s2"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document, over 3-word shingles at 0.9."""
    return jaccard_components(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(s) AS s FROM (SELECT doc_id, CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END AS l FROM w WHERE len(w) > 0), unnest(l) AS u(s)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 90 * (na.n + nb.n - k)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.m AS component_id FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) m USING (doc_id)
"""
