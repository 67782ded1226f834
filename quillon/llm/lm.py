"""Language-model scoring by cross-entropy difference.

Two bigram models, of a target corpus and of the whole corpus as background, share one vocabulary: every word of
every document, and one unknown word. With c the counts of a model, N its tokens and V the vocabulary's size

    p(w)     = (s c(w) + ADDED) / (s N + ADDED V)
    p(w | h) = (s c(h w) + PRIOR p(w)) / (s c(h) + PRIOR)

where c(h) counts the words that come after h, and s matches the models: 1 for the target, its tokens over the
background's for the background, so both weigh their smoothing alike. Every context sums to 1. A row is
scored by the models of all other rows: its own counts are taken off first. Its score is the mean over its tokens
of target loss less background loss, in nats: the lower, the closer to the target.

No n-gram is dropped, and none is gathered: blocks of rows, a batch each, send their distinct words and bigrams to
buckets, dealt by hash, which add them up and send back the sums of those that other blocks have as well, in
the order in which they came. A word that every document has is one entry of a block, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import mapped, staged, table, tasks
from quillon.llm.grouped import by_group
from quillon.llm.labelled import training_labels

#: Added count of each word of the vocabulary, and weight of p(w) in a bigram's context, in counts.
ADDED, PRIOR = 0.5, 5.0
START = 2
#: No more rows of target ids are broadcast; beyond it the ids are joined by a shuffle.
MAX_BROADCAST_IDS = 2_000_000
#: Bytes of a hash that are kept.
KEPT = 7


def word_hashes(text: str | None) -> np.ndarray:
    """An even hash of each ASCII-lower-cased word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    known = {w: xxhash.xxh3_64_intdigest(w) & 0xFFFFFFFFFFFFFE for w in set(words)}
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def pair_hashes(words: np.ndarray) -> np.ndarray:
    """An odd hash of each word with the one before it, the first with the start mark."""
    before = np.append(np.uint64(START), words[:-1])[: len(words)]
    x = before * np.uint64(0x9E3779B97F4A7C15) ^ (words + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(8)) | np.uint64(1)


def _runs(*sorted_: np.ndarray) -> np.ndarray:
    """Where a new value of any of the arrays begins."""
    new = np.ones(len(sorted_[0]), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in sorted_], axis=0)
    return np.flatnonzero(new)


def added(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their summed columns of sums, the place of each key among them, and the stable order of keys."""
    order = np.argsort(keys, kind="stable")
    first = _runs(keys[order])
    place = np.empty(len(keys), np.int64)
    place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    return keys[order[first]], np.add.reduceat(sums[:, order], first, axis=1) if len(first) else sums, place, order


class Block:
    """A block's words and bigrams, all texts' words one after another and then all their bigrams.

    sums has for each distinct hash its occurrences, those that end a document, and the same in target
    documents.
    """

    def __init__(self, texts: list[tuple[np.ndarray, np.ndarray]], target: list[bool]) -> None:
        self.length = np.array([len(w) for w, _ in texts], np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.length)
        self.target = np.array(target, np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *(w for w, _ in texts), *(p for _, p in texts)])
        k, ends = len(self.doc), np.cumsum(self.length)[self.length > 0] - 1
        rows = np.zeros((4, 2 * k), np.int64)
        rows[0], rows[1, ends] = 1, 1
        docs = np.tile(self.doc, 2)
        rows[2:] = rows[:2] * self.target[docs]
        self.keys, self.sums, self.place, self.order = added(flat, rows)
        self.ends = rows[1]

    def own(self) -> np.ndarray:
        """Occurrences of each hash in its document alone, and those that end it. Equal hashes are in the order
        of documents, as words and bigrams have no hash in common."""
        docs, out = np.tile(self.doc, 2), np.empty((2, len(self.place)), np.int64)
        if len(docs):
            first = _runs(self.place[self.order], docs[self.order])
            many = np.diff(np.append(first, len(docs)))
            out[:, self.order] = np.repeat(np.stack([many, np.add.reduceat(self.ends[self.order], first)]), many, axis=1)
        return out

    def losses(self, model: dict) -> np.ndarray:
        """Each text's mean loss under the target and the background model without it; nan without words."""
        k, own, out = len(self.doc), self.own(), []
        mine, word, pair = self.target[self.doc], self.place[:k], self.place[k:]
        begins = np.append(True, self.doc[1:] != self.doc[:-1])[:k]
        for row, s, tokens, starts, part in ((2, 1.0, model["t"], model["t_docs"], mine), (0, model["scale"], model["n"], model["n_docs"], np.ones(k, np.int64))):
            count = self.sums[row : row + 2, word] - part * own[:, :k]
            one = (s * count[0] + ADDED) / (s * (tokens - part * self.length[self.doc]) + ADDED * model["size"])
            given = np.where(begins, starts - part, np.append(0, (count[0] - count[1])[:-1])[:k])
            p = (s * (self.sums[row, pair] - part * own[0, k:]) + PRIOR * one) / (s * given + PRIOR)
            with np.errstate(invalid="ignore"):
                out.append(np.bincount(self.doc, -np.log(p), len(self.length)) / np.where(self.length > 0, self.length, np.nan))
        return np.stack(out)


def _pack(sums: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    return press.compress(np.ascontiguousarray(sums).view(np.uint8).reshape(4, -1, 8).transpose(0, 2, 1).tobytes())


def _unpack(load: bytes, press: zstandard.ZstdDecompressor) -> np.ndarray:
    body = np.frombuffer(press.decompress(load), np.uint8).reshape(4, 8, -1).transpose(0, 2, 1)
    return np.ascontiguousarray(body).view(np.int64).reshape(4, -1)


def _keys(load: bytes) -> np.ndarray:
    keys = np.zeros((len(load) // KEPT, 8), np.uint8)
    keys[:, :KEPT] = np.frombuffer(load, np.uint8).reshape(-1, KEPT)
    return keys.view("<u8").ravel()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as one row: its number and its rows, compressed."""
    press, first = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 33
    for k, b in enumerate(batches):
        with pa.BufferOutputStream() as sink:
            with pa.ipc.new_stream(sink, b.schema) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([first | k], pa.int64()), pa.array([press.compress(sink.getvalue())], pa.binary())], ["block", "load"])


def _rows(load: bytes) -> tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]], list[bool]]:
    """ids, words and bigrams, and marks of a block's rows."""
    rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(load)).read_all().combine_chunks()
    return rows.column(0).combine_chunks(), [grams(t.as_py()) for t in rows.column(1)], rows.column(2).to_pylist()


def _dealt(keys: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """Which of the sorted keys go to which bucket."""
    bucket = (keys // np.uint64(2) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
    return [(int(bucket[order[i]]), order[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    words = word_hashes(text)
    return words, pair_hashes(words)


def _marked(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and whether targets has the id, of every row of docs."""
    ids = targets.select(targets[id_col].alias("id")).filter(F.col("id").isNotNull()).distinct().withColumn("target", F.lit(True))
    if ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(ids, "id", "left").select("id", "text", F.coalesce("target", F.lit(False)).alias("target"))


def _add(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """What one bucket sends back to each block: sums in the order of the block's hashes, 0 for those that no
    other block has; and its totals, as block -1."""
    squeeze, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    loads = [(_keys(k.as_py()), _unpack(x.as_py(), squeeze)) for k, x in zip(group["keys"], group["load"], strict=True)]
    keys, sums, place, _ = added(np.concatenate([x[0] for x in loads]), np.concatenate([x[1] for x in loads], axis=1))
    names = ["block", "bucket", "load", "words", "n", "n_docs", "t", "t_docs"]

    def batch(*row) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    word, bucket, at = keys % np.uint64(2) == 0, group["bucket"][0].as_py(), 0
    yield batch(-1, bucket, b"", int(word.sum()), *sums[:, word].sum(1).tolist())
    for block, (_, own) in zip(group["block"].to_pylist(), loads, strict=True):
        found = sums[:, place[at : at + own.shape[1]]]
        at += own.shape[1]
        yield batch(block, bucket, _pack(found * (found[0] > own[0]), press), 0, 0, 0, 0, 0)


def score_all(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens long, target_loss, background_loss, score double (target less background) of every row.

    docs is the background; targets has the ids (column id_col) of its target documents. Null and empty
    texts: 0 tokens and null losses. Without target tokens every score is 0. Repeated rows are separate
    documents with equal results; an empty table gives an empty result; other columns stay out.
    """
    spark = docs.sparkSession
    kind = docs.select(id_col).schema.fields[0].dataType.simpleString()
    blocks = staged(_marked(docs, targets, id_col, text_col).transform(mapped, _blocks, "block long, load binary"), "lm-blocks")
    buckets = tasks(spark, 12)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for block, load in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                _, texts, target = _rows(load.as_py())
                sums = Block(texts, target)
                parts = _dealt(sums.keys, buckets)
                keys = [sums.keys[x].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes() for _, x in parts]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in parts], pa.int64()), pa.array([block] * len(parts), pa.int64()), pa.array(keys, pa.binary()), pa.array([_pack(sums.sums[:, x], press) for _, x in parts], pa.binary())], ["bucket", "block", "keys", "load"])

    sums = "words long, n long, n_docs long, t long, t_docs long"
    asked = blocks.transform(mapped, deal, "bucket long, block long, keys binary, load binary")
    answers = staged(by_group(asked, "bucket", _add, f"block long, bucket long, load binary, {sums}"), "lm-answers")
    total = answers.filter("block < 0").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "n", "n_docs", "t", "t_docs"))).first().asDict()
    model = total | {"size": total["words"] + 1, "scale": total["t"] / max(1, total["n"])}

    def finish(group: pa.Table) -> Iterator[pa.RecordBatch]:
        squeeze, sent = zstandard.ZstdDecompressor(), dict(zip(group["bucket"].to_pylist(), group["load"], strict=True))
        ids, texts, target = _rows(sent[None].as_py())
        rows = Block(texts, target)
        for bucket, spots in _dealt(rows.keys, buckets):
            found = _unpack(sent[bucket].as_py(), squeeze)
            more = found[0] > 0
            rows.sums[:, spots[more]] = found[:, more]
        target_loss, loss = rows.losses(model)
        empty = np.isnan(loss)
        cols = [pa.array(x, pa.float64(), mask=empty) for x in (target_loss, loss, target_loss - loss)]
        yield pa.RecordBatch.from_arrays([ids, pa.array(rows.length), *cols], [id_col, "n_tokens", "target_loss", "background_loss", "score"])

    both = blocks.unionByName(answers.filter("block >= 0").select("block", "bucket", "load"), allowMissingColumns=True)
    return by_group(both, "block", finish, f"`{id_col}` {kind}, n_tokens long, target_loss double, background_loss double, score double")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document: the target is what labels.quality marks as good, held-out rows apart, the
    background all documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = training_labels(labels, "doc_id", "quality").filter("y = 1").select(F.col("id").alias("doc_id"))
    return score_all(docs, good)
