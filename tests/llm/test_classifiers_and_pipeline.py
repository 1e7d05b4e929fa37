import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stacksift.llm import quality, toxicity
from stacksift.llm.common import pack, unpack
from stacksift.llm.labelled import sample

MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")


def labels_of(spark, label):
    return {r["doc_id"]: r[label] for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}


def ranked(score, y):
    order = np.argsort(np.argsort(score))
    ones, zeros = y.sum(), (1 - y).sum()
    return (order[y == 1].sum() - ones * (ones - 1) / 2) / (ones * zeros)


@pytest.mark.parametrize(("run", "label", "modulus", "remainder", "threshold", "least"), [(quality.quality, "quality", 4, 2, 0.7, 0.97), (toxicity.toxicity, "toxic", 5, 0, 0.5, 0.85)])
def test_held_out(spark, tables, run, label, modulus, remainder, threshold, least):
    rows = run(*tables).collect()
    assert len(rows) == tables[0].count()
    known = labels_of(spark, label)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in known]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold) for r in rows)
    score, y = np.array([r["score"] for r in held]), np.array([known[r["doc_id"]] for r in held])
    assert ranked(score, y) >= least


@pytest.mark.parametrize("run", [quality.quality, toxicity.toxicity])
def test_odd_rows(spark, frame, odd, run):
    df = frame(odd)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int, y int")
    assert {r["score"] for r in run(df, none).collect()} == {0.5}
    some = spark.createDataFrame([(4, 1, 1, 0), (4, 0, 0, 0), (9, 0, 0, 0), (10, 0, 0, 0), (7, 0, 1, 0), (None, 1, 1, 0), (5, None, None, 0), (3, 2, 2, 0), (2, 0, 0, 0)], "doc_id long, quality int, toxic int, y int")
    rows = run(df, some).collect()
    assert len(rows) == len(odd) and all(np.isfinite(r["score"]) for r in rows)
    assert len({(r["score"], r["held_out"]) for r in rows if r["doc_id"] == 4}) == 1
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert run(frame([]), some).collect() == []


def test_scores_dont_depend_on_batches(spark):
    texts = [f"some words {i} and others idiot{i}" .encode() * (i % 7) for i in range(60)]
    y = np.arange(60) % 2
    model = toxicity.fit(texts, y, 0.5, rounds=1, steps=2)
    assert np.allclose(model.score(texts), [model.score([t])[0] for t in texts])
    other = quality.fit(texts, y, 0.5, steps=5)
    assert np.allclose(other.score(texts), [other.score([t])[0] for t in texts])


def plain_windows(text):
    """Words of a text by the contract of ``Bags``, in windows; each word as its marked grams' buckets."""
    words = [w for w in bytes(text).translate(toxicity.LETTERS).split(b" ") if w]
    words = [w for i, w in enumerate(words) if not i or w != words[i - 1]]
    grams = []
    for w in words:
        marked = b" " + w + b" "
        grams.append([bucket_of(marked[i : i + n]) for n in toxicity.GRAMS for i in range(len(marked) - n + 1)])
    starts = range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE) if words else ()
    return [sum(grams[s : s + toxicity.WINDOW], []) for s in starts]


def bucket_of(gram):
    """A gram's bucket, its hash computed digit by digit."""
    mask = (1 << 64) - 1
    h = sum((c + 1) * pow(toxicity.BASE, i, 1 << 64) for i, c in enumerate(gram)) + len(gram) & mask
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
    h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
    return (h ^ h >> 31) & (toxicity.BUCKETS - 1)


def test_toxicity_scores_against_plain_code():
    rng = np.random.default_rng(1)
    texts = ["", " ", "a", "One word's enough", "é ß 猫 " * 5, "go go go stop", *(" ".join("".join(rng.choice(list("abc"), int(rng.integers(1, 8)))) for _ in range(n)) for n in (3, 8, 9, 12, 13, 40))]
    model = toxicity.Model(rng.normal(size=toxicity.BUCKETS), -0.3)
    got = model.score([t.encode() for t in texts])
    for t, s in zip(texts, got, strict=True):
        means = [np.mean([model.value[b] for b in w]) if w else 0.0 for w in plain_windows(t.encode())]
        assert abs(s - 1 / (1 + np.exp(-(max(means, default=0.0) + model.bias)))) < 1e-9, t


@pytest.mark.parametrize("chunk", [1, 60, 1 << 20])
def test_bags_against_plain_code(monkeypatch, chunk):
    monkeypatch.setattr(toxicity, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    known = ["".join(rng.choice(list("abc"), int(rng.integers(1, 8)))) for _ in range(30)]
    texts = [t.encode() for t in ["", "ab", " ", "é 猫 b2 " * 5, *(" ".join(["start", *rng.choice(known, n), "end"]) for n in (1, 6, 7, 20, 60))]]
    y = np.arange(len(texts)) % 2
    bags, value = toxicity.Bags(texts), rng.normal(size=toxicity.BUCKETS)
    windows = [(d, w) for d, t in enumerate(texts) for w in plain_windows(t)]
    assert bags.of.tolist() == [d for d, _ in windows] and bags.docs == len(texts)
    flat, row = bags.spread(bags.begin, bags.end)
    assert [sorted(flat[row == i].tolist()) for i in range(len(windows))] == [sorted(w) for _, w in windows]
    assert np.allclose(bags.means(value), [value[w].mean() for _, w in windows]) and bags.weight.tolist() == [len(w) for _, w in windows]
    some = sorted({b for _, w in windows for b in w})
    held = [[len({d for d, w in windows if y[d] == v and b in w}) for v in (1, 0)] for b in some]
    odds = [min(5, max(-2, np.log((p + 0.5) / (y.sum() + 1)) - np.log((n + 0.5) / ((1 - y).sum() + 1)))) if p + n >= 4 else 0 for p, n in held]
    assert np.allclose(toxicity._odds(bags, y)[some], odds)


def test_fit_holds_each_word_once():
    rng = np.random.default_rng(6)
    known = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(2000)]
    texts = [" ".join(rng.choice(known, 1500)).encode() for _ in range(300)]
    tracemalloc.start()
    toxicity.fit(texts, np.arange(300) % 2, 0.5, rounds=1, steps=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 * sum(map(len, texts))


def test_quality_scores_against_plain_code():
    rng = np.random.default_rng(2)
    texts = [b"", b"  ", b"a", "Some Words, AND some 12 more é!".encode(), b"go go stop go", *(b" ".join(rng.choice([b"ab", b"Cd", b"EFG", b"x1", b"."], n)) for n in (3, 50))]
    model = quality.fit(texts + [b"another one", b"ab cd"], np.array([0, 1] * 4 + [1]), 0.5, steps=20)
    a, b, c, d = model.layers
    for t, s in zip(texts, model.score(texts), strict=True):
        words = t.split()
        buckets = [int(quality.tokens([w])[0][0]) for w in words]
        shapes = [int(quality.tokens([w])[1][0]) for w in words]
        n = max(1, len(words))
        x = [*(sum(model.vectors[i].astype(float) for i in buckets) / n if words else np.zeros(quality.DIM)), *(sum(quality.SHAPE[i].astype(float) for i in shapes) / n if words else np.zeros(quality.DIM))]
        x += [sum(buckets[i] == buckets[i - k] for i in range(k, len(words))) / n for k in (1, 2)]
        x += [np.linalg.norm(sum(quality.INDEX[i].astype(float) for i in buckets)) / n if words else 0.0, np.log1p(len(words)) / 10]
        hidden = np.tanh((np.array(x) - model.centre) / model.spread @ a + b)
        assert abs(s - 1 / (1 + np.exp(-(hidden @ c + d) / model.temperature))) < 1e-6


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i}") for i in range(400)] + [(41, "x" * 200_000), (42, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(43)], "doc_id long, toxic int")
    texts, y, _ = sample(docs, labels, "toxic", F.lit(False), (100, 100))
    assert len(texts) == 41 and b"" in texts and max(map(len, texts)) < 20 and len(y) == 41
    assert len(sample(docs, labels, "toxic", F.lit(False), (4, 4))[0]) <= 10


def test_misspelt_words_share_grams():
    rng = np.random.default_rng(0)
    plain = [" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40)) for _ in range(400)]
    texts = [(t + " horridword" if i % 4 == 0 else t).encode() for i, t in enumerate(plain)]
    model = toxicity.fit(texts, np.array([i % 4 == 0 for i in range(400)], int), 0.25)
    score = model.score([b"aaaa bbbb horridwordz cccc", b"aaaa bbbb cccc dddd", b"xx horidword xx"])
    assert score[0] > 0.5 > score[1] and score[2] > score[1]


def test_pack_round_trip():
    arrays = [np.arange(5, dtype=np.int64), np.zeros(0, np.uint8), np.array([1, 2**63], np.uint64), np.array([1.5, -2], np.float64)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, unpack(pack(*arrays)), strict=True))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    known = labels_of(spark, "toxic")
    now, ids = docs, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        now_before = now
        now = corpus_pipeline.cut(stage(spark, now, MID))
        kept = {r["doc_id"] for r in now.select("doc_id").collect()}
        assert kept <= ids
        if name != "packing":
            assert now.columns == docs.columns and now.count() == len(kept)
        if name == "toxicity":
            seen = {d for d in known if known[d] == 1 and zlib.crc32(str(d).encode()) % 5}
            assert len(seen & kept) <= len(seen) // 20  # of the toxic documents that it learnt from
            assert all(d in kept for d, toxic in known.items() if not toxic)
            scored = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(now_before, spark.read.parquet(f"{MID}/labels.parquet")).collect()}
            assert kept == {d for d, predicted in scored.items() if not predicted}
        if name in ("suffix_dedup", "packing"):
            assert kept == ids
        ids = kept
    run = corpus_pipeline.run(spark, MID)
    assert run.drop("sequence_id", "offset").exceptAll(now.drop("sequence_id", "offset")).count() == 0 and run.count() == now.count()


def test_pipeline_on_odd_rows(spark, frame, odd):
    now = frame(odd)
    for _, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.cut(stage(spark, now, MID))
    assert now.count() > 0
    now = frame([])
    for _, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.cut(stage(spark, now, MID))
    assert now.count() == 0
