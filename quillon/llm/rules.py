"""Quality rules from compression bands.

A text's zstandard ratio (bytes over compressed bytes) tells repetition from noise: the whole
document and fixed chunks of it, the last one overlapping the one before so that no tail is left out, must lie
within limits that depend on length, as short texts compress less. Repetitive texts, tables and lists with one
mark after each word lie above them, random or encoded text below. The limits are
for prose of alphabetic scripts; 0 of 3,302 good and 173 of 301 bad labelled texts of the tables at 0.1 that pass
the base rules lie outside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import ASCII_SPACE, mapped, table

SYMBOLS = b"#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
#: (bytes, limit) of whole texts, linear in the logarithm of the bytes between; the end limits hold beyond.
LOWEST = ((128, 1.0), (256, 1.08), (512, 1.22), (1024, 1.34), (4096, 1.4), (65536, 1.45))
HIGHEST = ((128, 1.7), (256, 1.8), (512, 1.93), (1024, 2.09), (2048, 2.23), (4096, 2.33), (8192, 2.43), (16384, 2.53), (65536, 2.76))
#: Bytes of a chunk, the limits of its ratio, and the share of chunks outside them that a text may have (none in short texts).
CHUNK, CHUNK_LIMITS, MAX_BAD_CHUNKS = 1024, (1.34, 2.6), 0.1
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, bad_chunks double, base_failed boolean, kept boolean"


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows found twice or more. Names of 1, 2, 4, 8 words are exact ranks, not hashes."""
    n = len(words)
    if n <= window:
        return 0
    last = dict(zip(words, range(n), strict=True))
    if len(last) == n:
        return 0
    name, span = np.fromiter(map(last.__getitem__, words), np.int64, n), 1
    while span < window:
        step = min(span, window - span)
        name = pd.factorize(name[:-step] * n + name[step:])[0].astype(np.int64)
        span += step
    hit = np.bincount(name)[name] > 1
    if not hit.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    edge[: len(hit)] += hit
    edge[window : window + len(hit)] -= hit
    return int((np.cumsum(edge[:n]) > 0).sum())


def limit(n: int, nodes: tuple[tuple[int, float], ...]) -> float:
    """The limit for a text of n bytes."""
    return float(np.interp(np.log2(max(n, 1)), [np.log2(x) for x, _ in nodes], [y for _, y in nodes]))


def measure(text: str | None, press: zstandard.ZstdCompressor) -> tuple:
    """The figures and verdicts of one text, in the order of COLUMNS."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text or "") - len(raw) + len(raw.translate(None, ASCII_SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = repeat_words(words)
    ratio = len(raw) / len(press.compress(raw)) if raw else 0.0
    parts = [raw[min(i, len(raw) - CHUNK) :][:CHUNK] for i in range(0, len(raw), CHUNK)] if len(raw) > CHUNK else []
    bad = sum(not CHUNK_LIMITS[0] <= CHUNK / len(press.compress(x)) <= CHUNK_LIMITS[1] for x in parts) / max(1, len(parts))
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    kept = not failed and limit(len(raw), LOWEST) <= ratio <= limit(len(raw), HIGHEST) and bad <= MAX_BAD_CHUNKS
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, ratio, bad, failed, kept


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the base figures, ratios and verdicts of every row.

    Null and empty texts have no words: base_failed is true and kept false. Repeated rows give repeated
    results; an empty table gives an empty result. Other columns of docs stay out, whatever their names.
    No shuffle takes place, and a task holds one batch of texts at a time.
    """
    kind = docs.select(id_col).schema.fields[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            found = list(zip(*(measure(t.as_py(), press) for t in b.column(1)), strict=True)) or [()] * 9
            types = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(found, types, strict=True))], names)

    names = [id_col, *(x.split()[0] for x in COLUMNS.split(", "))]
    return docs.select(docs[id_col], docs[text_col]).transform(mapped, run, f"`{id_col}` {kind}, {COLUMNS}")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over every whole text of documents."""
    return quality_rules(table(spark, sf_dir, "documents"))
