"""Operators of the training-data pipeline against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from quillon.llm import common, grouped, jaccard, lm, mixing, neighbours, pieces, quality, rules, sharding, suffixes, toxicity

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, ids string, slot string, node string, unit string"
#: Null, empty and blank texts, no words of ours, unusual characters, one very long word, a long text.
ODD = [None, "", "   \n\t ", "a", "a b", "é 日本 🎉 \u0000  x", "x" * 5000, "word " * 3000, "Tie", "Tie", "\x0b\x0c\x1c\x85 nel"]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, sources=None):
    """Documents with columns whose names clash with those of operators."""
    rows = [(i, t, "en", None if sources is None else sources[i], None, -1, -1.0, "x", "x", "x", "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(df, *cols):
    return {r.doc_id: tuple(r[c] for c in cols) for r in df.collect()}


# brute force


def brute_set(text, width=3):
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return set() if not w else {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute_components(n, linked):
    comp = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return comp


def brute_repeats(texts, size=400):
    raw = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + size] for x in raw for i in range(len(x) - size + 1))
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - size + 1):
            if count[x[i : i + size]] > 1:
                gone[i : i + size] = True
        kept = bytes(b for b, g in zip(x, gone, strict=False) if not g)
        out.append((len(x), len(x) - len(kept), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def near_copies():
    rng = random.Random(11)
    texts = []
    for _ in range(4):
        base = prose(120, rng).split()
        for _ in range(14):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    shared = prose(30, rng)
    return texts + [f"{prose(60, rng)} {shared} {prose(60, rng)}" for _ in range(40)] + [prose(rng.randint(1, 30), rng) for _ in range(40)] + ODD


@pytest.mark.parametrize(("width", "percent", "largest"), [(3, 90, 4096), (5, 80, 4096), (3, 90, 5)])
def test_jaccard(spark, monkeypatch, width, percent, largest):
    monkeypatch.setattr(jaccard, "MAX_GROUP", largest)
    texts = near_copies()
    sets = [brute_set(t, width) for t in texts]
    want = brute_components(len(texts), lambda i, j: bool(sets[i] and sets[j]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]))
    got = by_id(jaccard.jaccard_components(frame(spark, texts), width=width, percent=percent), "n_shingles", "component_id")
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, want, strict=True))}


def test_jaccard_ids_and_empty(spark):
    same, rows = prose(50), [(None, "only null"), (None, "only null"), (4, "z"), (4, "z")]
    df = spark.createDataFrame([(7, same), (None, same), *rows], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=str)
    assert got == sorted([(7, 48, 7), (None, 48, 7), (None, 1, None), (None, 1, None), (4, 1, 4), (4, 1, 4)], key=str)
    assert jaccard.jaccard_components(frame(spark, []).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    comp = {}
    for a, b in edges:
        comp.setdefault(a, a), comp.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.node: r.component for r in grouped.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in comp.items() if n in got} and all(comp[n] == n for n in comp.keys() - got.keys())


@pytest.mark.parametrize("largest", [1500, 3, 1])
def test_suffixes(spark, monkeypatch, largest):
    monkeypatch.setattr(suffixes, "MAX_GROUP", largest)
    rng = random.Random(3)
    base, texts = ["".join(rng.choice("ab ") for _ in range(2500)) for _ in range(2)], []
    for _ in range(50):
        x = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 3, 8])):
            x[rng.randrange(len(x))] = rng.choice("aé€")
        k = rng.randrange(len(x))
        texts.append("".join(x[k:] + x[: rng.randrange(600)]))
    passage = "".join(rng.choice("cdefg") for _ in range(430))
    texts += ["".join(rng.choice("hijk") for _ in range(300)) + passage + "".join(rng.choice("hijk") for _ in range(300)) for _ in range(12)]
    texts += ["x" * 1000, "xy" * 300, "p" * 399, "q" * 400, "r" * 401, "é" * 300, *ODD[:6], "same " * 90, "same " * 90]
    got = by_id(suffixes.remove_repeats(frame(spark, texts)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == dict(enumerate(brute_repeats(texts)))
    got = by_id(suffixes.remove_repeats(frame(spark, texts), report=120), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes")
    assert got == {i: (*x, y[1]) for i, (x, y) in enumerate(zip(brute_repeats(texts), brute_repeats(texts, 120), strict=True))}
    kept = suffixes.remove_repeats(frame(spark, texts), keep_text=True)
    assert {r["row"].doc_id: len(r.kept_text.encode()) <= r.n_bytes for r in kept.collect()} == dict.fromkeys(range(len(texts)), True)
    assert suffixes.remove_repeats(frame(spark, []).limit(0)).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(1)
    for n, a in [(1, 1), (2, 2), (3, 1), (4, 2), (50, 2), (1000, 2), (1001, 3), (1002, 250)]:
        s = rng.integers(1, a + 1, n).astype(np.uint64)
        raw = s.astype(np.uint8).tobytes()
        assert suffixes.suffix_order(s, n + 1).tolist() == sorted(range(n), key=lambda i: raw[i:])


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 24)
    monkeypatch.setattr(neighbours, "MAX_SHARD", 40)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(260, 16))
    for i in range(120, 200):
        x[i] = x[i % 7] + rng.normal(size=16) * 0.05 * rng.integers(1, 6)
    x[200:206] = x[3]
    rows = [(i, [float(np.float32(v)) for v in x[i]], None if i % 50 == 9 else i % 2) for i in range(260)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, [1.0, None], 1), (304, [], 1), (305, [1.0] * 3, 1), (306, [2.0] * 3, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    ok = {i: np.array(v, float) / np.linalg.norm(v) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    lab = {i: a for i, _, a in rows}
    ids = [i for i, _, _ in rows]
    linked = lambda a, b: a in ok and b in ok and lab[a] == lab[b] and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= 0.93
    comp = brute_components(len(ids), lambda i, j: linked(ids[i], ids[j]))
    want = {v: (sum(linked(v, u) for u in ids if u != v), ids[comp[k]], ids[comp[k]] == v) for k, v in enumerate(ids)}
    found = neighbours.near_duplicates(df)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found.collect()} == want
    r = neighbours.recall(df, found, every=2).first()
    assert r.expected == r.found > 0
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_of_many_shards(spark, monkeypatch):
    """Links of unclustered vectors, whose ends are mostly near to different ones of hundreds of centres."""
    monkeypatch.setattr(neighbours, "SHARD", 12)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(1500, 64))
    side -= (side * x[:1500]).sum(1, keepdims=True) * x[:1500]
    x[1500:] = 0.935 * x[:1500] + np.sqrt(1 - 0.935**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in neighbours.near_duplicates(df).collect()}
    near = x @ x.T >= 0.93
    assert got == {i: (int(near[i].sum()) - 1, i % 1500) for i in range(3000)}


def test_pieces(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [prose(RNG.randint(1, 80)).title() + RNG.choice([" ", "\n", " -- ", "  "]) + prose(5) for _ in range(60)] + ODD + ["▁ is a space", "a  b   c", " lead", "== -- ''"]
    got = by_id(pieces.encode(frame(spark, texts)), "ids", "round_trip", "n_tokens")
    for i, t in enumerate(texts):
        assert got[i][0] == ([] if t is None else sp.encode(t)) and got[i][2] == len(got[i][0]), repr(t)
        assert got[i][1] is (None if t is None else "▁" not in t)
    back = by_id(pieces.decode(pieces.encode(frame(spark, texts))), "text")
    assert all(back[i] == ((t or "").replace("▁", " "),) for i, t in enumerate(texts))
    assert pieces.encode(frame(spark, []).limit(0)).count() == 0


def brute_rules(text):
    raw = (text or "").encode()
    w = raw.split()
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in raw.split(b"\n") if x.strip()]
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed


def brute_bands(text):
    """kept, whole ratio, share of bad chunks, base_failed, by the limits of the module."""
    raw, failed = (text or "").encode(), brute_rules(text)[5]
    size = lambda x: len(zstandard.ZstdCompressor(level=3).compress(x))

    def limit(nodes):
        n = max(1, len(raw))
        for (x, y), (x2, y2) in zip(nodes, nodes[1:], strict=False):
            if x <= n <= x2:
                return y + (y2 - y) * (math.log2(n) - math.log2(x)) / (math.log2(x2) - math.log2(x))
        return nodes[0][1] if n < nodes[0][0] else nodes[-1][1]

    ratio, bad, n = len(raw) / size(raw) if raw else 0.0, 0, 0
    if len(raw) > rules.CHUNK:
        ends = [*range(rules.CHUNK, len(raw), rules.CHUNK), len(raw)]
        n, bad = len(ends), sum(not rules.CHUNK_LIMITS[0] <= rules.CHUNK / size(raw[e - rules.CHUNK : e]) <= rules.CHUNK_LIMITS[1] for e in ends)
    share = bad / max(1, n)
    return not failed and limit(rules.LOWEST) <= ratio <= limit(rules.HIGHEST) and share <= rules.MAX_BAD_CHUNKS, ratio, share, failed


def test_rules(spark):
    line = prose(12)
    texts = [prose(200), f"{line}\n{prose(30)}\n{line}\n\n{line}", "# a|b <c> " * 30, prose(15), "a b c d e f g h " * 9, *ODD]
    got = by_id(rules.quality_rules(frame(spark, texts)), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {i: brute_rules(t) for i, t in enumerate(texts)}
    noise = "".join(chr(33 + RNG.randrange(90)) for _ in range(1500))
    many = ["".join(RNG.choice("eeeaaioutnsrhldcmfpgwybvkxqz") for _ in range(RNG.randint(1, 9))) for _ in range(1500)]
    rich = lambda n: " ".join(RNG.choice(many) for _ in range(n))
    texts = [rich(300), rich(40) + " " + "z" * 9000, noise, rich(2000), rich(600) + " " + noise, rich(600) + " " + "z" * 1500, rich(10) + " " + noise[:900], " ".join(w + "###" for w in prose(400).split()), *texts]
    kept = by_id(rules.quality_rules(frame(spark, texts)), "kept", "ratio", "bad_chunks", "base_failed")
    assert {i: kept[i] for i in kept} == {i: brute_bands(t) for i, t in enumerate(texts)}
    assert [kept[i][0] for i in range(8)] == [True, False, False, True, False, False, False, False]
    assert rules.quality_rules(frame(spark, []).limit(0)).count() == 0


def test_mixing(spark):
    texts = [prose(RNG.randint(1, 60)) for _ in range(600)] + ODD
    sources = [RNG.choice(["a", "b", "b", "b", "é", None, "z"]) for _ in texts]
    df = frame(spark, texts, sources)
    rows = mixing.mix(df, block_words=50, shards=5).collect()
    size = [len((t or "").encode().split()) for t in texts]
    order = sorted({s for s in sources if s is not None}, key=lambda s: s.encode()) + [None]
    total = [sum(n for n, x in zip(size, sources, strict=True) if x == s) for s in order]
    target = mixing.fill_targets(total, [(3.0, 1.0, 2.0)[i % 3] for i in range(len(order))], 1.5 * sum(total), 2.0)
    assert abs(sum(target) - 1.5 * sum(total)) < 1e-6 and all(t <= 2 * n + 1e-9 for t, n in zip(target, total, strict=True))
    got = {r.doc_id: r for r in rows}
    assert {i: r["size"] for i, r in got.items()} == dict(enumerate(size))
    for k, s in enumerate(order):
        mine = [r for r in rows if sources[r.doc_id] == s]
        assert sum(r.taken for r in mine) == int(target[k] + 1e-6) and all(r.taken <= 2 * r["size"] and r.source_size == total[k] for r in mine)
    per_shard = Counter()
    for r in rows:
        assert r.taken == sum(d.words for d in r.draws)
        for d in r.draws if r["size"] < 100 else ():
            per_shard[d.shard] += d.words
    assert set(per_shard) <= set(range(5)) and max(per_shard.values()) < 1.5 * min(per_shard.values())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(7), block_words=50, shards=5).collect()))
    assert mixing.mix(df.limit(0)).count() == 0


def test_hypergeometric():
    rng = random.Random(1)
    draws = [mixing.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.15 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.4
    quotas = [100, 7, 0, 53]
    split = mixing.split_quotas(quotas, 6, 9)
    assert [sum(s[i] for s in split) for i in range(4)] == quotas and max(map(sum, split)) - min(map(sum, split)) <= 1


def test_sharding(spark):
    names = [f"s{i}" for i in range(9)]
    table = sharding.lookup_table(names, 1009)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 8) < 0.15 * 1009
    assert Counter(sharding.lookup_table(["a", "b"], 1009, [1, 3]))[1] > 700
    df = frame(spark, ODD).unionByName(spark.createDataFrame([(None,) * 11], SCHEMA))
    got = sharding.shard(df, "doc_id", names)
    assert got.count() == len(ODD) + 1 and got.filter("shard is null").count() == 0 and got.columns[-2:] == ["slot", "shard"]
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString() and "Python" not in got._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="prime"):
        sharding.lookup_table(names, 1000)


def labelled(spark, n, good, bad, label):
    """Texts and labels of two kinds, dealt by chance."""
    rng, texts, labels = random.Random(6), [], []
    for i in range(n):
        y = rng.random() < 0.6
        texts.append(good(rng) if y else bad(rng))
        labels.append((i, int(y)))
    df = frame(spark, texts + ODD)
    return df, spark.createDataFrame([*labels, (None, 1), (0, 1 - labels[0][1])], f"doc_id long, {label} int"), labels


def test_quality(spark):
    df, labels, truth = labelled(spark, 600, lambda r: prose(r.randint(10, 80), r).capitalize() + ".", lambda r: " ".join(w.upper() + "!!" for w in prose(r.randint(10, 80), r).split()), "quality")
    scored = by_id(quality.score(df, quality.train(df, labels)), "score")
    held = [(i, y) for i, y in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(scored) == 600 + len(ODD) and all(0 <= s <= 1 for (s,) in scored.values())
    assert np.mean([(scored[i][0] >= 0.7) == y for i, y in held]) > 0.97
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert by_id(quality.score(df, quality.train(df, flipped)), "score") == scored  # held-out labels aren't read
    assert quality.score(df.limit(0), quality.train(df.limit(0), labels)).count() == 0


def test_prior_needs_no_negatives(spark):
    rng = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.9):
        good = lambda n: rng.normal(1.5, 1, (n, 4))
        u = np.concatenate([good(int(4000 * share)), rng.normal(-1.5, 1, (4000 - int(4000 * share), 4))])
        assert abs(quality.estimate_prior(good(2000), rng.permutation(u)) - share) < 0.08
    df, labels, _ = labelled(spark, 300, lambda r: prose(r.randint(10, 80), r).capitalize() + ".", lambda r: " ".join(w.upper() + "!!" for w in prose(r.randint(10, 80), r).split()), "quality")
    few = {r.doc_id: r.score for r in quality.score(df, quality.train(df, labels.filter("quality = 1"))).collect()}
    assert few == {r.doc_id: r.score for r in quality.score(df, quality.train(df, labels.filter("quality = 1 or doc_id <> 0"))).collect()}
    assert {r.score for r in quality.score(df, quality.train(df, labels.limit(0))).collect()} == {0.5}


def test_toxicity(spark):
    insults = ["blockhead", "rotter", "nitwit"]

    def bad(r):
        w = prose(60, r).split()
        for _ in range(r.randint(1, 8)):
            w[r.randrange(60)] = r.choice(insults)
        return " ".join(w)

    df, labels, truth = labelled(spark, 600, bad, lambda r: prose(60, r), "toxic")
    got = by_id(toxicity.score(df, toxicity.train(df, labels)), "severity", "p_toxic", "toxic")
    held = [(i, y) for i, y in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i][2] == bool(y) for i, y in held]) > 0.97
    texts = {r.doc_id: r.text for r in df.collect()}
    count = lambda i: sum(w in insults for w in texts[i].split())
    many = [got[i][0] for i, y in held if y and count(i) >= 6]
    few = [got[i][0] for i, y in held if y and count(i) <= 2]
    assert np.mean(many) > np.mean(few) + 0.5 and not any(got[600 + k][2] for k in range(len(ODD)))
    assert toxicity.score(df.limit(0), toxicity.train(df.limit(0), labels)).count() == 0


def test_ordinal_gradient_reaches_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 3))
    z = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=1500)
    w, cut = toxicity.fit_ordinal(x, np.searchsorted([-1.0, 0.5, 2.0], z), 4, decay=0)
    assert np.allclose(w, [2, -1, 0], atol=0.3) and np.allclose(cut, [-1, 0.5, 2], atol=0.3)


def brute_lm(words, chosen, target, i):
    """p(w | h) of the target and the background model without document i, and their vocabulary."""
    vocab = {w for x in words for w in x}
    sets = [[x for k, x in enumerate(words) if k in chosen], words]
    n = [sum(map(len, x)) for x in sets]
    scale = [1.0, n[0] / max(1, n[1])]
    models = []
    for s, x in zip(scale, ([x for k, x in enumerate(words) if k in chosen and k != i], [x for k, x in enumerate(words) if k != i]), strict=True):
        one, two, given = Counter(w for y in x for w in y), Counter(p for y in x for p in zip([None, *y], y, strict=False)), Counter(h for y in x for h in [None, *y][: len(y)])

        def p(w, h, s=s, one=one, two=two, given=given):
            alone = (s * one[w] + lm.ADDED) / (s * sum(one.values()) + lm.ADDED * (len(vocab) + 1))
            return (s * two[h, w] + lm.PRIOR * alone) / (s * given[h] + lm.PRIOR)

        models.append(p)
    return models, vocab


def test_lm(spark, monkeypatch):
    monkeypatch.setattr(common, "BATCH_ROWS", "7")
    rng = random.Random(12)
    texts = [prose(60, rng) + f" rare{i} rare{i}x" for i in range(30)] + [" ".join(reversed(prose(60, rng).upper().split())) + " tgt tgt" for _ in range(20)] + ["tgt", "tgt", *ODD]
    df = frame(spark, texts)
    targets = spark.createDataFrame([(i,) for i in range(30, 51)] + [(30,), (None,)], "doc_id long")
    words = [(t or "").encode().lower().split() for t in texts]
    got = by_id(lm.score_all(df, targets), "n_tokens", "target_loss", "background_loss", "score")
    chosen = set(range(30, 51))
    for i, seq in enumerate(words):
        assert got[i][0] == len(seq)
        if not seq:
            assert got[i][1:] == (None, None, None)
            continue
        models, vocab = brute_lm(words, chosen, i in chosen, i)
        want = [-np.mean([np.log(p(w, h)) for h, w in zip([None, *seq], seq, strict=False)]) for p in models]
        assert np.allclose(got[i][1:], [*want, want[0] - want[1]]) and min(want) >= 0, i
        if i in (0, 35):
            assert all(abs(sum(p(w, h) for w in [*vocab, b"never seen"]) - 1) < 1e-9 for p in models for h in (None, seq[0], b"never seen"))
    assert np.mean([got[i][3] for i in range(30, 50)]) < np.mean([got[i][3] for i in range(30)])
    assert all(abs(r.score) < 1e-9 for r in lm.score_all(df, targets.limit(0)).filter("n_tokens > 0").collect())
    assert lm.score_all(df.limit(0), targets).count() == 0
    again = df.unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    assert lm.score_all(again, targets).count() == len(texts) + 1
