"""Toxicity by cumulative-link ordinal regression.

P(grade <= k) = sigmoid(threshold_k - w.x): the thresholds are ordered, the weights are shared. x marks
which words, and beginnings of words, of a selected vocabulary a text has. The model gives the expected severity, the sum over k
of P(grade > k).

Where labels only say toxic or not, grades above 0 come from the labelled texts themselves: words that
stand almost only in toxic texts are counted, and terciles of their density grade the toxic texts 1
to 3. Grade 0 against the rest is always the given label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import mapped, staged, table
from quillon.llm.labelled import bounded_ids, held_out, texts_of, training_labels

#: Bounds of a fit: texts of each label, and words of the vocabulary.
MAX_TEXTS, MAX_WORDS, MIN_TEXTS = 4096, 1024, 4
#: Bytes of the beginnings of longer words that are features as well.
BEGINNINGS = (4, 5, 6, 8)
FORM = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A or 0x30 <= c <= 0x39 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words in ASCII lower case, without ASCII punctuation."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FORM).split()


def features_of(words: list[bytes]) -> set[bytes]:
    """Distinct words, and beginnings marked by ^."""
    once = set(words)
    out = set(once)
    for k in BEGINNINGS:
        out.update([b"^" + w[:k] for w in once if len(w) > k])
    return out


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, steps: int = 500, rate: float = 0.05, decay: float = 5e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ordered thresholds) by maximum likelihood with an L2 penalty, through Adam.

    Thresholds are t0 and t0 plus sums of exponentials, so they stay in order.
    """
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    n, d = x.shape
    free = np.concatenate([np.zeros(d), [1.0], np.zeros(grades - 2)])
    m, v = np.zeros_like(free), np.zeros_like(free)
    for t in range(1, steps + 1):
        w, cut = free[:d], free[d] + np.concatenate([[0.0], np.cumsum(np.exp(free[d + 1 :]))])
        z = (x @ w.astype(x.dtype)).astype(float)
        upper = np.append(sig(cut[None, :] - z[:, None]), np.ones((n, 1)), axis=1)
        lower = np.append(np.zeros((n, 1)), upper[:, :-1], axis=1)
        at = (np.arange(n), grade)
        u, low = upper[at], lower[at]
        du, dl = u * (1 - u), low * (1 - low)
        p = np.maximum(u - low, 1e-9)
        gz = (du - dl) / p / n  # of the loss by z
        g_cut = np.array([-(du / p)[grade == k].sum() + (dl / p)[grade == k + 1].sum() for k in range(grades - 1)]) / n
        steps_up = np.exp(free[d + 1 :])
        g = np.concatenate([(gz.astype(x.dtype) @ x).astype(float) + decay * w, [g_cut.sum()], [g_cut[j + 1 :].sum() * steps_up[j] for j in range(grades - 2)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        free -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return free[:d], free[d] + np.concatenate([[0.0], np.cumsum(np.exp(free[d + 1 :]))])


def grades_from_labels(x: np.ndarray, toxic: np.ndarray, n_words: np.ndarray, share: np.ndarray) -> np.ndarray:
    """0 where not toxic, else 1 to 3 by terciles of the density of words found almost only in toxic texts."""
    density = x[:, share >= 0.95].sum(1) / np.maximum(1, n_words)
    cuts = np.quantile(density[toxic == 1], [1 / 3, 2 / 3]) if (toxic == 1).any() else [0, 0]
    return np.where(toxic == 1, 1 + np.searchsorted(cuts, density, side="left"), 0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", grades: int | None = None) -> dict:
    """A model from at most MAX_TEXTS texts of either kind, held-out rows apart.

    grades: label_col already has grades 0 to grades - 1; without it, it is 0 or 1 and grades are made.
    Without a text of both kinds the model finds nothing toxic.
    """
    y = training_labels(labels, id_col, label_col)
    totals = {r.bad: r.n for r in y.groupBy((F.col("y") > 0).alias("bad")).agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = bounded_ids(y.filter("y > 0"), MAX_TEXTS).unionByName(bounded_ids(y.filter("y <= 0"), MAX_TEXTS))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [words_of(t.as_py()) for t in b.column(1)]
            once = [sorted(w.decode("latin-1") for w in features_of(x)) for x in found]  # any bytes have a name
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, found)), pa.int32()), pa.array(once, pa.list_(pa.string()))], ["y", "n", "words"])

    rows = staged(texts_of(docs, ids, id_col, text_col).select("y", "text").transform(mapped, split, "y int, n int, words array<string>"), "toxicity-texts")
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("y") > 0).cast("int")), F.lit(0)).alias("bad")).first()
    nothing = {"vocab": {}, "w": np.zeros(0), "cut": np.array([30.0, 31.0, 32.0])}
    if not sums.bad or sums.bad == sums.n:
        return nothing
    seen = rows.select((F.col("y") > 0).cast("int").alias("bad"), F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("k"), F.sum("bad").alias("b")).filter(F.col("k") >= MIN_TEXTS)
    base = sums.bad / sums.n
    rate = (F.col("b") + F.lit(base)) / (F.col("k") + 1)
    gain = F.col("k") * (rate * F.log(rate / base) + (1 - rate) * F.log((1 - rate) / (1 - base)))
    vocab = [(r.word, r.b / r.k) for r in seen.orderBy(gain.desc(), "word").limit(MAX_WORDS).collect()]
    place = {w: i for i, (w, _) in enumerate(vocab)}
    if not place:
        return nothing
    have = rows.select("y", "n", F.array_intersect("words", F.array(*[F.lit(w) for w in place])).alias("words")).toPandas()
    x = np.zeros((len(have), len(place)), np.float32)
    for i, words in enumerate(have.words):
        x[i, [place[w] for w in words]] = 1
    y_np = have.y.to_numpy()
    grade = y_np if grades else grades_from_labels(x, (y_np > 0).astype(int), have.n.to_numpy(), np.array([s for _, s in vocab]))
    w, cut = fit_ordinal(x, grade, grades or 4)
    odds = lambda bad, good: np.log(max(1, bad) / max(1, good))  # noqa: E731  from the sample's shares to the labels'
    cut = cut + odds(sums.bad, sums.n - sums.bad) - odds(totals.get(True, 0), totals.get(False, 0))
    return {"vocab": {k.encode("latin-1"): i for k, i in place.items()}, "w": w, "cut": cut}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, severity double (expected grade), p_toxic double (grade above 0), toxic boolean of every row.

    Null and empty texts score as texts without listed words. Repeated rows give repeated results, an
    empty table an empty one; other columns stay out. No shuffle.
    """
    kind = docs.select(id_col).schema.fields[0].dataType.simpleString()
    vocab, w, cut = model["vocab"], model["w"], model["cut"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.array([sum(w[vocab[t]] for t in vocab.keys() & features_of(words_of(x.as_py()))) for x in b.column(1)], float)
            above = 1 / (1 + np.exp(-np.clip(z[:, None] - cut[None, :], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)], [id_col, "severity", "p_toxic", "toxic"])

    return docs.select(docs[id_col], docs[text_col]).transform(mapped, run, f"`{id_col}` {kind}, severity double, p_toxic double, toxic boolean")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, severity, p_toxic, toxic and held_out of every document."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).withColumn("held_out", held_out(F.col("doc_id")))
