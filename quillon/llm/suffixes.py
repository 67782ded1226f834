"""Removal of long repeats by a distributed difference-cover suffix array.

Sorting every suffix of a corpus moves many times its bytes, so the work is first cut, exactly, into
parts that need no merge. Each start of a string is given to one anchor, the leftmost least hash of the
SEED-byte strings inside its first `report` bytes: equal strings have equal anchors at equal distances. Starts
whose anchor's seed occurs once in the corpus can't repeat. An anchor with its starts has a context, the
bytes that those strings cover; contexts that occur twice repeat as a whole, and of these one is kept. A text
gives a row for each of its distinct contexts, with the runs of starts where it has it, so a line that
a text repeats a thousand times is one row.

What is left is sorted by suffix, in buckets of seeds: suffixes at places 1 and 2 modulo 3 are sorted by
their triples; equal names recurse on the string of names; the remaining suffixes are sorted by their
first byte and the rank after it and merged; then neighbours' prefixes are compared, those of `report` and those
of `length` bytes. Names that already cover `length` bytes need no further recursion.

A seed with more than MAX_GROUP different contexts would be one large group. Its contexts are cut by distance
from the anchor into blocks of STEPS[0] starts, and grouped anew by what all strings of a block share: equal
strings stay together, the rest mostly part. Blocks that occur twice repeat as a whole, the others are sorted
as above; groups that are still larger are cut into shorter blocks, at last into single strings, which
counting settles. Nothing is dropped on either way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import discard, mapped, staged, table
from quillon.llm.grouped import by_group

SEED, MAX_GROUP, BUCKET, SEGMENT = 80, 1500, 512, 1 << 21
#: Starts of a block in groups that are too large, and in what is too large still.
STEPS = (32, 4, 1)
#: Passages of over 50 words, of four letters and a space or so, have this many bytes at least.
PASSAGE = 240
#: Bytes sorted at a time, unless one seed alone has more; names of so many suffixes fit in 21 bits.
SORTED = 1_400_000
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64
_BYTES = np.frombuffer(hashlib.shake_256(b"bytes").digest(8 * 256), np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Roller:
    """Hashes of all strings of a width in a byte array, through sums of powers modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def hashes(self, data: np.ndarray, width: int) -> np.ndarray:
        n = len(data)
        if n < width:
            return np.zeros(0, np.uint64)
        if len(self.up) <= n:
            self.up, self.down = _powers(BASE, 2 * n + 2), _powers(pow(BASE, -1, 1 << 64), 2 * n + 2)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.up[:n], out=total[1:])
        x = (total[width:] - total[: n - width + 1]) * self.down[: n - width + 1]
        x ^= x >> U(31)
        x *= U(0xBF58476D1CE4E5B9)
        x ^= x >> U(29)
        return x


def anchors(data: np.ndarray, length: int, roller: Roller) -> Iterator[tuple[int, int, int]]:
    """(seed hash, first start, last start) of each anchor's starts in a text."""
    width = length - SEED + 1
    for at in range(0, len(data) - length + 1, SEGMENT):
        part = data[at : at + SEGMENT + length - 1]
        seeds = roller.hashes(part, SEED)
        low = (seeds & U(0xFFFFFFFF00000000)) | np.arange(len(seeds), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        spot = (low & U(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, spot[1:] != spot[:-1]))
        last = np.append(first[1:], len(spot)) - 1
        yield from zip(seeds[spot[first]].tolist(), (first + at).tolist(), (last + at).tolist(), strict=True)


#: Symbols, names and places of a bucket have 21 bits, so two of them and a place are one number to sort.
BITS, LOW = U(21), U((1 << 21) - 1)


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Order of keys under 2**42 (ties by place), the dense rank from 1 of each, and the number of ranks."""
    both = np.sort(key << BITS | np.arange(len(key), dtype=np.uint64))
    order, key = (both & LOW).astype(np.int64), both >> BITS
    new = np.ones(len(key), np.uint64)
    new[1:] = key[1:] != key[:-1]
    np.cumsum(new, out=new)
    rank = np.empty(len(key), np.uint64)
    rank[order] = new
    return order, rank, int(new[-1])


def _below(base: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each key the number of values of base under it; both are under 2**42."""
    both = np.sort(np.concatenate([(base << U(1) | U(1)) << BITS, key << U(22) | np.arange(len(key), dtype=np.uint64)]))
    of_base = (both >> BITS & U(1)).astype(bool)
    out = np.empty(len(key), np.int64)
    out[(both[~of_base] & LOW).astype(np.int64)] = np.cumsum(of_base)[~of_base]
    return out


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of s (values from 1 up; values and length under 2**21) by a difference cover; suffixes that
    agree in their first `depth` symbols may stand in any order."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    x = np.concatenate([s, np.zeros(6, s.dtype)]).astype(np.uint64)
    n0, n1, n2 = (n + 2) // 3, (n + 2) // 3, n // 3  # where n is 3k + 1, place n stands among those at 1, so that each at 0 has a next
    zero = x[0::3], x[1::3], x[2::3], x[3::3], x[4::3]
    pair = np.concatenate([zero[1][:n1] << BITS | zero[2][:n1], zero[2][:n2] << BITS | zero[3][:n2]])
    follow = np.concatenate([zero[2][:n1] << BITS | zero[3][:n1], zero[3][:n2] << BITS | zero[4][:n2]])
    order, name, names = _ranked(pair >> BITS << BITS | _ranked(follow)[1])
    if names < n1 + n2 and depth > 3:
        order = suffix_order(name, -(-depth // 3))
    rank = np.empty(n1 + n2, np.uint64)
    rank[order] = np.arange(1, n1 + n2 + 1, dtype=np.uint64)
    at_one, at_two = rank[:n1], np.append(rank[n1:], np.zeros(n1 - n2, np.uint64))
    key = zero[0][:n0] << BITS | at_one
    rest = 3 * _ranked(key)[0]
    by_one = _below(key, zero[1][:n1] << BITS | at_two)
    # places at 2 are followed by one at 0 and one at 1, places at 0 by one at 1 and one at 2
    after = np.append(at_one[1:], np.zeros(1, np.uint64))[:n2]
    tail = _ranked(np.concatenate([zero[1][:n0] << BITS | at_two, zero[3][:n2] << BITS | after]))[1]
    by_two = _below(zero[0][:n0] << BITS | tail[:n0], zero[2][:n2] << BITS | tail[n0:])
    before = np.concatenate([by_one, by_two])[order]
    sample = np.where(order < n1, 3 * order + 1, 3 * (order - n1) + 2)
    there = sample < n
    sample = sample[there]
    before = np.maximum.accumulate(before[there])  # among suffixes that agree in depth symbols the order is free
    out = np.empty(n, np.int64)
    mine = before + np.arange(len(sample))
    out[mine] = sample
    free = np.ones(n, bool)
    free[mine] = False
    out[free] = rest
    return out


def repeated_starts(contexts: list[bytes], reach: list[int], report: int, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each context its starts up to `reach` whose strings of `report` and of `length` bytes occur again in
    these contexts. Starts beyond it belong to the next anchor of the text, so they stand in another context."""
    data = np.frombuffer(b"".join(contexts), np.uint8)
    ends = np.cumsum([0, *map(len, contexts)])
    bounds = list(zip(ends.tolist(), ends[1:].tolist(), strict=False))
    order = suffix_order(data.astype(np.uint64) + U(1), length)
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(8, np.uint8)), 8)[: len(data)]).view("<u8").ravel()
    found = []
    for width in dict.fromkeys((report, length)):
        starts = np.zeros(len(data), bool)
        for (a, b), far in zip(bounds, reach, strict=True):
            starts[a : max(a, min(a + far, b - width) + 1)] = True
        mine = order[starts[order]]
        same = np.arange(len(mine) - 1)
        for k in [*range(0, width - 8, 8), width - 8]:
            same = same[eight[mine[same] + k] == eight[mine[same + 1] + k]]
        again = np.zeros(len(data), bool)
        again[mine[same]] = again[mine[same + 1]] = True
        found.append([np.flatnonzero(again[a:b]) for a, b in bounds])
    return list(zip(found[0], found[-1], strict=True))


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(x) != 1)
    return list(zip(x[np.append(0, cut + 1)].tolist(), x[np.append(cut, len(x) - 1)].tolist(), strict=True)) if len(x) else []


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _name(raw: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(raw)
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _longs(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _batch(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema, strict=True)], [n for n, _ in schema])


#: Runs of starts; `wide` tells whether of strings of `length` or of `report` bytes.
SPANS = [("t1", pa.int64()), ("t2", pa.int64()), ("wide", pa.bool_()), ("start", pa.int64()), ("last", pa.int64())]
SPAN_SCHEMA = "t1 long, t2 long, wide boolean, start long, last long"
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("last", pa.int64())]))


def contexts_of(raw: bytes, report: int, length: int, roller: Roller) -> dict[tuple[int, int], list[list[int]]]:
    """(seed, hash of the context) of a text's anchors, with runs of their starts and how often each comes."""
    view, out = memoryview(raw), {}
    for g, first, last in anchors(np.frombuffer(raw, np.uint8), report, roller):
        key = g, xxhash.xxh3_64_intdigest(view[first : last + length], last - first)
        if (runs := out.get(key)) is None:
            out[key] = [[first, last, 1]]
        elif runs[-1][1] + 1 == first:
            runs[-1][1:] = last, runs[-1][2] + 1
        else:
            runs.append([first, last, 1])
    return out


def blocks_of(raw: bytes, reach: int, step: int, report: int, length: int, roller: Roller) -> Iterator[tuple[int, int, int, int]]:
    """(hash of what all strings of a block share, hash of the block, first start, last start) of a context's
    blocks: `step` starts, counted from the anchor, so that equal strings stand in equal places of blocks."""
    view = memoryview(raw)
    seeds = roller.hashes(np.frombuffer(raw, np.uint8)[:report], SEED)
    spot = int(np.argmin((seeds & U(0xFFFFFFFF00000000)) | np.arange(len(seeds), dtype=np.uint64)))
    for k in range((spot - reach) // step, spot // step + 1):
        last = spot - k * step
        core = xxhash.xxh3_64_intdigest(view[last : last - step + 1 + report], k)
        first, last = max(0, last - step + 1), min(reach, last)
        yield core, xxhash.xxh3_64_intdigest(view[first : last + length], (spot - first) * step + last - first), first, last


def cut_blocks(large: DataFrame, step: int, report: int, length: int) -> tuple[DataFrame, DataFrame | None]:
    """Contexts of large groups (g, m, t1, t2, start, reach, bytes) in blocks of `step` starts: spans of the blocks
    that repeat as a whole, and what is left to compare, in the same columns (None for single strings)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for b in batches:
            rows = []
            for g, t1, t2, at, reach, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [(g, core - (1 << 63), c - (1 << 63), t1, t2, at, at + i, at + j, at + min(j, len(raw) - length)) for core, c, i, j in blocks_of(raw, reach, step, report, length, roller)]
            yield _batch([(n, pa.int64()) for n in ("g", "h", "c", "t1", "t2", "at", "start", "last", "far")], rows)

    chosen = large.select("g", "t1", "t2", "start", "reach", "bytes")
    blocks = staged(chosen.transform(mapped, find, "g long, h long, c long, t1 long, t2 long, at long, start long, last long, far long").distinct(), "repeat-blocks")
    counted = blocks.groupBy("g", "h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t1", "t2", "at", "start", "last")).alias("one"))
    again = blocks.join(counted.filter("n > 1").select("g", "h", "c").hint("merge"), ["g", "h", "c"], "left_semi")
    wide = again.filter("start <= far").select("t1", "t2", F.lit(True).alias("wide"), "start", F.col("far").alias("last"))
    if step == 1:
        again = blocks.join(blocks.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g", "h").hint("merge"), ["g", "h"], "left_semi")
    spans = wide if report == length else wide.unionByName(again.select("t1", "t2", F.lit(False).alias("wide"), "start", "last"))
    if step == 1:
        return spans, None
    counted = staged(counted.select("g", "h", "one"), "repeat-block-contexts")
    mixed = counted.groupBy("g", "h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    need = counted.join(mixed.hint("merge"), ["g", "h"]).select(F.xxhash64("g", "h").alias("g"), "m", "one.*")
    lists = need.groupBy("t1", "t2", "at").agg(F.collect_list(F.struct("g", "m", "start", "last")).alias("places")).withColumnRenamed("at", "from")
    held = chosen.select("t1", "t2", F.col("start").alias("from"), "bytes").join(lists.hint("merge"), ["t1", "t2", "from"])
    part = F.substring("bytes", F.col("p.start") - F.col("from") + 1, F.col("p.last") - F.col("p.start") + length)
    return spans, held.select("t1", "t2", "from", "bytes", F.explode("places").alias("p")).select("p.g", "p.m", "t1", "t2", "p.start", (F.col("p.last") - F.col("p.start")).alias("reach"), part.alias("bytes"))


def repeat_starts(docs: DataFrame, text_col: str, length: int, report: int | None = None) -> DataFrame:
    """t1, t2 (name of a text), wide, start, last: runs of starts of strings of `length` bytes (wide) and of
    `report` bytes (by default `length` as well) that start anywhere else too."""
    report = report or length
    if not SEED < report <= length:
        raise ValueError(f"report has to be over {SEED} and no more than length")
    both = report < length

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        names = ["g", "c", "t1", "t2", "n", "size", "span", "runs"]

        def packed(cols: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([_longs(cols[0]), _longs(cols[1]), *(pa.array(c, pa.int64()) for c in cols[2:7]), pa.array(cols[7], RUNS)], names)

        for b in batches:
            cols: list[list] = [[] for _ in names]
            for t in b.column(0):
                raw = _raw(t.as_py())
                if len(raw) >= report:
                    t1, t2 = _name(raw)
                    for (g, c), runs in contexts_of(raw, report, length, roller).items():
                        n, (first, last, times) = sum(r[2] for r in runs), runs[0]
                        for col, x in zip(cols, (g, c, t1, t2, n, len(raw), (last - first + 1) // times, [(r[0], r[1]) for r in runs]), strict=True):
                            col.append(x)
                if len(cols[0]) > 50_000:
                    yield packed(cols)
                    cols = [[] for _ in names]
            yield packed(cols)

    found = staged(docs.select(docs[text_col].alias("text")).transform(mapped, find, "g long, c long, t1 long, t2 long, n long, size long, span long, runs array<struct<start: long, last: long>>"), "repeat-anchors")
    # written by itself, so that the join deals both sides anew and a seed of very many rows can be split
    often = staged(found.groupBy("g").agg(F.sum("n").alias("n")).filter("n > 1").select("g"), "repeat-often")
    shared = staged(found.join(often.hint("merge"), "g"), "repeat-shared")
    discard(found, often)
    first = F.col("runs")[0]["start"]
    contexts = shared.groupBy("g", "c").agg(F.sum("n").alias("n"), F.min(F.struct("t1", "t2", first.alias("start"), (first + F.col("span") - 1).alias("last"))).alias("at"))
    contexts = staged(contexts, "repeat-contexts")
    whole = shared.join(contexts.filter("n > 1").select("g", "c").hint("merge"), ["g", "c"], "left_semi").select("t1", "t2", "size", F.explode("runs").alias("run")).select("t1", "t2", "size", "run.*").distinct()
    wide = whole.withColumn("last", F.least("last", F.col("size") - length)).filter("start <= last")
    whole = wide.select("t1", "t2", F.lit(True).alias("wide"), "start", "last").unionByName(whole.select("t1", "t2", F.lit(False).alias("wide"), "start", "last")) if both else wide.select("t1", "t2", F.lit(True).alias("wide"), "start", "last")
    mixed = staged(contexts.groupBy("g").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "repeat-mixed-seeds")
    need = staged(contexts.join(mixed.hint("merge"), "g").select("g", "m", "at.*"), "repeat-mixed")
    if need.isEmpty():
        return whole

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, seen = zstandard.ZstdCompressor(level=1), set()
        for b in batches:
            rows = []
            for t in b.column(0):
                raw = _raw(t.as_py())
                if len(raw) >= report and (x := _name(raw)) not in seen:
                    seen.add(x)
                    rows.append((*x, press.compress(raw)))
            yield _batch([("t1", pa.int64()), ("t2", pa.int64()), ("z", pa.binary())], rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for big in batches:
            for i in range(0, big.num_rows, 200):
                rows = []
                for t1, t2, z, places in zip(*(c.to_pylist() for c in big.slice(i, 200).columns), strict=True):
                    raw = press.decompress(z)
                    rows += [(p["g"], p["m"], t1, t2, p["start"], p["last"] - p["start"], raw[p["start"] : p["last"] + length]) for p in places]
                yield _batch([("g", pa.int64()), ("m", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("start", pa.int64()), ("reach", pa.int64()), ("bytes", pa.binary())], rows)

    lists = need.groupBy("t1", "t2").agg(F.collect_list(F.struct("g", "m", "start", "last")).alias("places"))
    named = docs.select(docs[text_col].alias("text")).transform(mapped, name, "t1 long, t2 long, z binary")
    cuts = staged(named.join(lists.hint("merge"), ["t1", "t2"]).transform(mapped, cut, "g long, m long, t1 long, t2 long, start long, reach long, bytes binary"), "repeat-bytes")

    def sort(group: pa.Table) -> Iterator[pa.RecordBatch]:
        # a text that many rows repeat has come more than once
        once = dict(zip(zip(*(group[c].to_pylist() for c in ("g", "t1", "t2", "start")), strict=True), zip(group["bytes"].to_pylist(), group["reach"].to_pylist(), strict=True), strict=True))
        keys = sorted(once)
        ends = [i for i in range(1, len(keys) + 1) if i == len(keys) or keys[i][0] != keys[i - 1][0]]
        at, size, last = 0, 0, 0
        cuts = []
        for end in ends:
            more = sum(len(once[k][0]) for k in keys[last:end])
            if size and size + more > SORTED:
                cuts.append((at, last))
                at, size = last, 0
            size, last = size + more, end
        for a, b in [*cuts, (at, last)]:
            rows = []
            for k, (short, long_) in zip(keys[a:b], repeated_starts(*map(list, zip(*(once[k] for k in keys[a:b]), strict=True)), report, length), strict=True):
                _, t1, t2, start = k
                rows += [(t1, t2, True, start + i, start + j) for i, j in _runs(long_)]
                if both:
                    rows += [(t1, t2, False, start + i, start + j) for i, j in _runs(short)]
            yield _batch(SPANS, rows)

    parts, small = whole, cuts.filter(F.col("m") <= MAX_GROUP)
    for step in STEPS:
        large = cuts.filter(F.col("m") > MAX_GROUP)
        if large.isEmpty():
            break
        spans, cuts = cut_blocks(large, step, report, length)
        parts = parts.unionByName(spans)
        if cuts is None:
            break
        cuts = staged(cuts, "repeat-block-bytes")
        small = small.unionByName(cuts.filter(F.col("m") <= MAX_GROUP))
    buckets = max(1, small.count() // BUCKET)
    small = small.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)))
    return parts.unionByName(by_group(small.select("bucket", "g", "t1", "t2", "start", "reach", "bytes"), "bucket", sort, SPAN_SCHEMA))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep_text: bool = False, report: int | None = None) -> DataFrame:
    """id, n_bytes long, n_removed long, n_spans long, kept_sha256 string of every row, and kept_text string
    with keep_text, where bytes of characters cut in two go as well; `row`, the whole row, then stands for id.
    With report, n_passage_bytes long: the bytes that repeated strings of so many bytes cover, which stay.

    A byte goes if a `length`-byte string that covers it starts anywhere else in the column, in UTF-8.
    Null and short texts lose nothing; null counts as empty. Repeated rows repeat each other. An empty
    table gives an empty result; other columns stay out, whatever their names.
    """
    starts = repeat_starts(docs, text_col, length, report)
    spans = staged(starts.groupBy("t1", "t2").agg(F.collect_list(F.struct("wide", "start", "last")).alias("spans")), "repeat-spans")
    chosen = docs.select((F.struct("*") if keep_text else docs[id_col]).alias("id"), docs[text_col].alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            raws = [_raw(t.as_py()) for t in b.column(1)]
            names = [_name(x) for x in raws]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in names], pa.int64()), pa.array([x[1] for x in names], pa.int64()), pa.array([press.compress(x) for x in raws], pa.binary())], ["id", "t1", "t2", "z"])

    def covered(n: int, spans: list[dict], wide: bool, width: int) -> np.ndarray:
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, [x["start"] for x in spans if x["wide"] == wide], 1)
        np.add.at(edge, [x["last"] + width for x in spans if x["wide"] == wide], -1)
        return np.cumsum(edge[:-1]) > 0

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for big in batches:
            for i in range(0, big.num_rows, 500):
                b, out = big.slice(i, 500), []
                for z, spans in zip(b.column(1), b.column(2), strict=True):
                    raw, n_spans, passages = press.decompress(z.as_py()), 0, 0
                    kept = raw
                    if spans.is_valid:
                        runs = spans.as_py()
                        gone = covered(len(raw), runs, True, length)
                        n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                        passages = int(covered(len(raw), runs, False, report).sum()) if report else 0
                    out.append((len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if keep_text else None, passages))
                rest = _batch([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()), ("n_passage_bytes", pa.int64())], out)
                yield pa.RecordBatch.from_arrays([b.column(0), *rest.columns], ["id", *rest.schema.names])

    named = chosen.transform(mapped, name, f"id {kind}, t1 long, t2 long, z binary")
    done = named.join(spans.hint("merge"), ["t1", "t2"], "left").select("id", "z", "spans").transform(mapped, apply, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, n_passage_bytes long")
    done = done if report else done.drop("n_passage_bytes")
    return done.withColumnRenamed("id", "row") if keep_text else done.drop("kept_text").withColumnRenamed("id", id_col)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, for strings of 400 bytes; and
    n_passage_bytes, the bytes that repeated strings of PASSAGE bytes cover."""
    return remove_repeats(table(spark, sf_dir, "documents"), report=PASSAGE)
