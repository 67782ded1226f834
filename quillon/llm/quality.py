"""Quality classifier from positive and unlabelled texts.

Trusted positives are labelled good texts; unlabelled ones are documents as they come; no label of a bad
text is read. The class prior is estimated from the two samples: a scorer that tells positives from unlabelled
texts is fit on half of them, and on the other half the prior is the least ratio, over its thresholds, of the
share of unlabelled texts above to the share of positives above. A linear scorer with logistic loss minimises the
non-negative unbiased risk  prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)])  by Adam; where
the bracket falls below zero its gradient is turned around, which keeps it from overfitting.

Features are of the form of a text alone: byte frequencies, hashed shapes of words, repetition.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import mapped, table
from quillon.llm.labelled import bounded_ids, held_out, texts_of, training_labels
from quillon.llm.rules import repeat_words

SHAPES, STATS = 256, 9
DIMS = 256 + SHAPES + STATS
#: Bounds of the samples that a fit sees; they hold the driver's memory at any input.
MAX_POSITIVE, MAX_UNLABELLED = 4096, 8192
THRESHOLD = 0.7
FORM = bytes(0x20 if c in b" \t\n\r\x0b\x0c" else 0x61 if 0x61 <= c <= 0x7A or c >= 0x80 else 0x41 if 0x41 <= c <= 0x5A else 0x30 if 0x30 <= c <= 0x39 else c for c in range(256))


def features(text: str | None, press: zstandard.ZstdCompressor) -> np.ndarray:
    """DIMS figures of one text; null is as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(DIMS, np.float32)
    words = raw.split()
    n = len(words)
    if not n:
        out[-1] = 1
        return out
    out[:256] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    form = np.frombuffer(raw.translate(FORM), np.uint8)
    form = form[np.append(True, form[1:] != form[:-1])]
    for shape, k in Counter(form.tobytes().split()).items():
        out[256 + zlib.crc32(shape) % SHAPES] += k / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    stats = (math.log1p(n) / 10, (len(raw) - n) / n / 10, repeat_words(words) / n, 1 - len(set(lines)) / len(lines), len(set(words)) / n, min(2.0, len(raw) / len(press.compress(raw)) / 5), min(1.0, n / 20), max(map(len, words)) / 1000, 0)
    out[-STATS:] = stats
    return out


def estimate_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, held off 0 and 1; p, u: their features.

    Above a threshold that negatives don't reach, the unlabelled are positives, so the ratio of the shares is
    the prior; elsewhere it is more. Each ratio is taken with the upper confidence bound of its two shares, and
    the ratio of the least bound counts.
    """
    if min(len(p), len(u)) < 4:
        return 0.5
    model = fit_nnpu(p[::2], u[::2], 0.5, negative=False)
    sp, su = (np.clip((x[1::2] - model["mean"]) / model["scale"], -8, 8) @ model["w"] for x in (p, u))
    cuts = np.unique(sp)
    above_p, above_u = (1 - np.searchsorted(np.sort(x), cuts, "left") / len(x) for x in (sp, su))
    slack = sum(np.sqrt(np.log(4 / delta) / 2 / len(x)) for x in (sp, su))
    best = int(np.argmin((above_u + slack) / above_p))
    return float(min(0.99, max(0.01, above_u[best] / above_p[best])))


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 600, rate: float = 0.02, decay: float = 1e-3, negative: bool = True) -> dict:
    """Weights that minimise the non-negative risk; p, u: features of positives and unlabelled texts.
    Without `negative` the plain risk of telling p from u."""
    both = np.concatenate([p, u])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = np.clip((p - mean) / scale, -8, 8), np.clip((u - mean) / scale, -8, 8)
    w = np.zeros(p.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    grad = lambda x, g: np.append(x.T @ g, g.sum())
    for t in range(1, steps + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))) for x in (p, u))
        bracket = -np.log1p(-np.minimum(su, 1 - 1e-9)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-9)).mean()
        if negative:
            rest = grad(u, su / len(u)) - prior * grad(p, sp / len(p))
            rest = rest if bracket >= 0 else -rest
        else:
            rest = (1 - prior) * grad(u, su / len(u))
        g = prior * grad(p, (sp - 1) / len(p)) + rest
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return {"w": w[:-1], "b": float(w[-1]), "mean": mean, "scale": scale, "prior": prior}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> dict:
    """A model from at most max_positive trusted texts and max_unlabelled others. Held-out rows are never
    learned from, nor are labels of bad texts. Without positives or texts the model scores every text with 0.5.
    A linear model of DIMS weights is fit well by so many texts; the sample is drawn by a hash of the id, and a
    document of many rows counts with the first of its texts in order."""
    y = training_labels(labels, id_col, label_col)
    positives = bounded_ids(y.filter("y = 1").select("id"), max_positive).withColumn("kind", F.lit(1))
    ids = docs.select(docs[id_col].alias("id")).filter(F.col("id").isNotNull() & ~held_out(F.col("id"))).distinct()
    others = bounded_ids(ids, max_unlabelled, seed=6).withColumn("kind", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            rows = [features(t.as_py(), press).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["kind", "x"])

    found = texts_of(docs, positives.unionByName(others), id_col, text_col).select("kind", "text").transform(mapped, run, "kind int, x binary").toPandas()
    p, u = (np.frombuffer(b"".join(found.x[found.kind == k]), np.float32).reshape(-1, DIMS).astype(np.float64) for k in (1, 0))
    if not len(p) or not len(u):
        prior = 0.5
        return {"w": np.zeros(DIMS), "b": math.log(prior / (1 - prior)), "mean": np.zeros(DIMS), "scale": np.ones(DIMS), "prior": prior}
    return fit_nnpu(p, u, estimate_prior(p, u))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """id and score of every row; with keep_row, score and the whole row as the struct `row`.

    Null and empty texts get a score as well. Repeated rows give repeated results, an empty table an
    empty one. Other columns stay out, whatever their names. No shuffle.
    """
    scale = 1 / model["scale"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = [float(np.clip((features(t.as_py(), press) - model["mean"]) * scale, -8, 8) @ model["w"]) + model["b"] for t in b.column(1)]
            scores = pa.array(1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30))), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), scores], ["id", "score"])

    first = F.struct("*") if keep_row else docs[id_col]
    chosen = docs.select(first.alias("id"), docs[text_col].alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    scored = chosen.transform(mapped, run, f"id {kind}, score double")
    return scored.withColumnRenamed("id", "row" if keep_row else id_col)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
