"""SentencePiece encoding and decoding by suffix-array matching.

A batch's text, as its distinct space-led units, is concatenated and its suffixes are sorted. Every
piece of the vocabulary is then one binary search for the range of suffixes that begin with it, which
gives all its occurrences in the batch at once. Occurrences are edges of a lattice; sorted by end
position they are relaxed from left to right.

For a merge (BPE) model the relaxation is exact: the encoding of a prefix ends in the one piece whose
predecessor, the last piece of the shorter prefix, stands next to it in an encoding of just the two.
So an edge is taken if that holds for its piece and the last piece where it starts. Units can be cut
before a space because no piece has a space after another character; load() verifies this.
"""

from __future__ import annotations

import re
import sys
import types
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillon.llm.common import mapped, table

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
KEY = 16  # bytes of a suffix that are sorted; pieces that are longer compare their rest
CHUNK_CHARS = 1 << 20  # characters of text whose units are held at a time
LEARN_CHARS = 1 << 18  # characters of new units that are matched at a time
MEMO_UNITS = 60_000  # units met again that a worker remembers; it forgets all when full
MEMO_PAIRS = 200_000
TABLE_BITS = 20
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
BREAK = b"\xfe"


def load(path: str = MODEL) -> dict:
    """Pieces, ranks and byte ids of a merge model; read on the driver and sent along with the task."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    plain = {sp.id_to_piece(i): i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    if any(SPACE in p.lstrip(SPACE) for p in plain) or not {c for p in plain for c in p} <= plain.keys():
        raise ValueError("pieces with inner spaces, or of characters that are no pieces, aren't supported")
    as_bytes = [sp.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
    for i in ids:
        if sp.is_byte(i):
            as_bytes[i] = bytes([int(sp.id_to_piece(i)[3:5], 16)])
        elif sp.is_control(i):
            as_bytes[i] = b""
        elif sp.is_unknown(i):
            as_bytes[i] = " ⁇ ".encode()
    return {"path": path, "pieces": plain, "score": {i: sp.get_score(i) for i in plain.values()}, "bytes": as_bytes, "byte_id": {as_bytes[i][0]: i for i in ids if sp.is_byte(i)}, "unk": sp.unk_id()}


class Encoder:
    def __init__(self, model: dict) -> None:
        self.model, self.units, self.pairs = model, {}, {}
        self.table = np.full(1 << TABLE_BITS, -1, np.int64)
        pieces = sorted(model["pieces"].items(), key=lambda x: len(x[0].encode()))
        raw = [p.encode() for p, _ in pieces]
        self.raw = dict(zip((i for _, i in pieces), (p for p, _ in pieces), strict=True))
        self.ids = np.array([i for _, i in pieces])
        self.sizes = np.array([len(x) for x in raw])
        self.low = np.array([x[:KEY] for x in raw], f"S{KEY}")
        self.high = np.array([x[:KEY].ljust(KEY, b"\xff") for x in raw], f"S{KEY}")
        self.long = [(k, x) for k, x in enumerate(raw) if len(x) > KEY]

    def merged(self, text: str) -> list[int]:
        """The encoding of a short text by its definition: merge the best-scored neighbours, leftmost first."""
        pieces, score, parts = self.model["pieces"], self.model["score"], list(text)
        while True:
            best = max(((score[pieces[j]], -k) for k in range(len(parts) - 1) if (j := parts[k] + parts[k + 1]) in pieces), default=None)
            if best is None:
                return [pieces[p] for p in parts]
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def beside(self, a: int, b: int) -> bool:
        """Whether a then b is how the two pieces' text is encoded."""
        key = a << 32 | b
        if (found := self.pairs.get(key)) is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(self.raw[a] + self.raw[b]) == [a, b]
        return found

    def edges(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every occurrence of every piece; piece -1: a character that is none."""
        data = np.frombuffer(text + bytes(KEY), np.uint8)
        starts = np.flatnonzero(((data[:-KEY] & 0xC0) != 0x80) & (data[:-KEY] != BREAK[0]))
        keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, KEY)[starts])
        halves = keys.view(">u8")
        suffixes = np.lexsort((halves[:, 1], halves[:, 0]))
        ordered = keys[suffixes].view(f"S{KEY}").ravel()
        first = np.searchsorted(ordered, self.low, "left")
        count = np.searchsorted(ordered, self.high, "right") - first
        total, which = int(count.sum()), np.repeat(np.arange(len(count)), count)
        at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        start = starts[suffixes[at]]
        if any(count[k] for k, _ in self.long):
            good = np.ones(total, bool)
            ends = np.cumsum(count)
            for k, x in self.long:
                for j in range(ends[k] - count[k], ends[k]):
                    good[j] = text[start[j] : start[j] + len(x)] == x
            start, which = start[good], which[good]
        end, piece = start + self.sizes[which], self.ids[which]
        bounds = np.append(np.flatnonzero((data[: len(text)] & 0xC0) != 0x80), len(text))
        widths = np.zeros(len(text) + 1, np.int64)
        widths[bounds[:-1]] = np.diff(bounds)
        alone = np.zeros(len(text) + 1, bool)
        alone[start[end - start == widths[start]]] = True
        odd = starts[~alone[starts]]
        return np.append(start, odd), np.append(end, odd + widths[odd]), np.append(piece, np.full(len(odd), -1))

    def beside_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """beside() of arrays of pieces: first by a table that a pair's hash indexes, then one by one."""
        key = a.astype(np.int64) << 32 | b
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        miss = np.flatnonzero(self.table[at] >> 1 != key)
        if len(miss):
            new, back = np.unique(key[miss], return_inverse=True)
            value = np.array([self.beside(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()])
            self.table[at[miss]] = key[miss] << 1 | value[back]
            out = (self.table[at] & 1).astype(bool)
            out[miss] = value[back]
            # a pair that shared its place with a missed one was overwritten, not looked up
            lost = np.flatnonzero(self.table[at] >> 1 != key)
            for i in lost.tolist():
                out[i] = self.beside(int(a[i]), int(b[i]))
            return out
        return (self.table[at] & 1).astype(bool)

    def learn(self, units: list[str]) -> list[bytes]:
        """The ids of each unit, as bytes. All units are relaxed together, one end position after another."""
        raw = [u.encode("utf-8", "replace") for u in units]
        text = BREAK.join(raw)
        sizes = np.array([len(x) for x in raw])
        begins = np.cumsum(np.append(0, sizes[:-1] + 1))
        start, end, piece = self.edges(text)
        depth = end - np.repeat(begins, sizes + 1)[start]
        order = np.argsort(depth.astype(np.uint16) if depth.max() < 65536 else depth, kind="stable")
        start, end, piece = start[order], end[order], piece[order]
        bounds = np.append(np.flatnonzero(np.diff(depth[order], prepend=-1)), len(order))
        last, back = np.full(len(text) + 1, -3, np.int32), np.zeros(len(text) + 1, np.int64)
        last[begins] = -2
        for i, j in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            q, p = last[start[i:j]], piece[i:j]
            good = (q > -3) & ((q < 0) | (p < 0))
            if len(ask := np.flatnonzero((q >= 0) & (p >= 0))):
                good[ask] = self.beside_all(q[ask], p[ask])
            e = end[i:j][good]
            last[e], back[e] = p[good], start[i:j][good]
        chosen, at = np.zeros(len(text) + 1, bool), begins + sizes
        low = begins
        while len(at):
            chosen[at] = True
            at = back[at]
            more = at > low
            at, low = at[more], low[more]
        ends = np.flatnonzero(chosen)
        ids, of = last[ends].astype(np.int32), np.searchsorted(ends, begins, "right")
        cuts = np.append(of, len(ends)).tolist()
        flat = ids.tobytes()
        out = [flat[4 * i : 4 * j] for i, j in zip(cuts, cuts[1:], strict=False)]
        byte_id, unk = self.model["byte_id"], self.model["unk"]
        for k in np.unique(np.searchsorted(of, np.flatnonzero(ids < 0), "right") - 1).tolist():  # units with characters that are no pieces
            found: list[int] = []
            for e in ends[cuts[k] : cuts[k + 1]].tolist():
                found += [int(last[e])] if last[e] >= 0 else [byte_id.get(x, unk) for x in text[back[e] : e]]
            out[k] = np.array(found, np.int32).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Piece ids of each text; few texts at a time are held as units."""
        out: list[np.ndarray] = []
        held: list[list[str]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            times = Counter(chain.from_iterable(held))
            new, now, at = [u for u in times if u not in self.units], {}, 0
            while at < len(new):  # a bounded part at a time, or one unit
                end, chars = at, 0
                while end < len(new) and (end == at or chars + len(new[end]) < LEARN_CHARS):
                    chars += len(new[end])
                    end += 1
                now.update(zip(new[at:end], self.learn(new[at:end]), strict=True))
                at = end
            known = now | {u: self.units[u] for u in times if u in self.units}
            out.extend(np.frombuffer(b"".join(map(known.__getitem__, units)), np.int32) for units in held)
            if len(self.units) > MEMO_UNITS:
                self.units.clear()
            self.units.update((u, x) for u, x in now.items() if times[u] > 1)
            held.clear()
            size = 0

        for t in texts:
            held.append(UNIT.findall(SPACE + t.replace(" ", SPACE)) if t else [])
            size += len(t or "")
            if size >= CHUNK_CHARS:
                flush()
        flush()
        return out


def decode_ids(ids: list[int], as_bytes: list[bytes]) -> str:
    """Text of piece ids; the space before the first piece goes."""
    raw = b"".join(map(as_bytes.__getitem__, ids))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _encoder(model: dict) -> Encoder:
    """A worker's encoder, kept from task to task."""
    memo = sys.modules.setdefault("_quillon_pieces", types.ModuleType("_quillon_pieces")).__dict__
    if memo.get("path") != model["path"]:
        memo.update(path=model["path"], encoder=Encoder(model))
    return memo["encoder"]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL) -> DataFrame:
    """id, ids array<int>, n_tokens long, round_trip boolean (decoding the ids gives the text) for each row.

    Null and empty texts have no ids (round_trip: true for '', null for null). A text that holds U+2581
    itself decodes to a space there, so round_trip is false. Repeated rows give repeated results, an
    empty table an empty one; other columns stay out. No shuffle; memory is bounded by a batch of texts.
    """
    model = load(model_path)
    kind = docs.select(id_col).schema.fields[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                b = big.slice(at, 1000)
                texts = b.column(1).to_pylist()
                ids = encoder.encode(texts)
                same = [None if t is None else decode_ids(i.tolist(), model["bytes"]) == t for t, i in zip(texts, ids, strict=True)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                values = pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(np.diff(ends).astype(np.int64)), pa.array(same, pa.bool_())], [id_col, "ids", "n_tokens", "round_trip"])

    return docs.select(docs[id_col], docs[text_col]).transform(mapped, run, f"`{id_col}` {kind}, ids array<int>, n_tokens long, round_trip boolean")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str = MODEL) -> DataFrame:
    """id and text of each row of ids. Null ids give a null text, no ids an empty one."""
    as_bytes = load(model_path)["bytes"]
    kind = encoded.select(id_col).schema.fields[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else decode_ids(x, as_bytes) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(encoded[id_col], encoded[ids_col]).transform(mapped, run, f"`{id_col}` {kind}, text string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text of documents, and whether they decode to it."""
    return encode(table(spark, sf_dir, "documents"))
