import math
import re
from collections import Counter

import numpy as np

from stacksift.llm import topk
from stacksift.llm.licenses import INSTEAD, SLACK, STRETCH, scan_licenses, templates, words
from stacksift.llm.topk import search, top_k


def brute_top(rows, k=5, every=50):
    fine = [(i, [np.floor(256.0 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in fine if i % every == 0}):
        vector = min(v for i, v in fine if i == q)
        scores = sorted((-int(sum(a * b for a, b in zip(vector, v, strict=False))), i) for i, v in fine if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, -2.0]), (50, [0.5, 0.5]), (50, [0.25, 0.5]), (1, [1.0, -2.0]), (1, [1.0, -2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, []), (7, [0.1]), (8, [0.1, 0.2, 0.3]), (None, [9.0, 9.0]), (100, None), (9, [0.001, -0.001])]
    df = spark.createDataFrame([(i, v, "q", 3) for i, v in rows], "vec_id long, embedding array<float>, v string, lane int")
    got = sorted(tuple(r) for r in top_k(df).collect())
    near = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute_top(near)
    assert top_k(df.limit(0)).collect() == []


def test_top_k_on_embeddings(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert sorted(tuple(r) for r in top_k(df).collect()) == brute_top(rows)


def test_grid_of_lanes_and_blocks(spark, data, monkeypatch):
    monkeypatch.setattr(topk, "LANE", 7)
    monkeypatch.setattr(topk, "BLOCK", 2)
    monkeypatch.setattr(topk, "PART", 1)
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert sorted(tuple(r) for r in top_k(df, every=20).collect()) == brute_top(rows, every=20)


def test_bounds_never_drop_a_winner():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(size=(3000, 64)))
    x[1000:2000] = x[0]
    ids = np.arange(3000)
    q, found, score = search(ids[:20], x[:20], ids, x, 5)
    for i in range(20):
        s = (x @ x[i]).astype(np.int64)
        order = [j for j in np.lexsort((ids, -s)) if j != i][:5]
        assert found[q == i].tolist() == order and score[q == i].tolist() == s[order].tolist()


def test_bound_holds_at_each_level():
    rng = np.random.default_rng(4)
    q, x = rng.normal(size=(5, 10)), rng.normal(size=(50, 10))
    for segments in (1, 3, 4, 16):
        assert (topk.statistics(q, segments) @ topk.statistics(x, segments).T >= q @ x.T - 1e-9).all()


def test_huge_components_saturate():
    assert topk.exact(np.array([1e30]), np.array([[1e30], [-1e30]])).tolist() == [topk.LONG.max, topk.LONG.min]


def brute_licences(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    places, labels = [], set()
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licences(frame, odd):
    texts = ["Under the MIT License! under the mit license", "Apache License, Version 2.0 CC-BY-NC", "cc by cc by nc nc", "mit", "the mit license", "apache license version 22", "É under the mit license"]
    rows = [*odd, *((100 + i, t) for i, t in enumerate(texts))]
    df = scan_licenses(frame(rows))
    got = df.collect()
    assert len(got) == len(rows)
    expected = sorted(((d, *brute_licences(t)) for d, t in rows), key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=str) == expected
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert scan_licenses(frame([])).collect() == []


def test_own_labels(frame):
    text = "This is distributed under the terms of the GNU General Public License as published by the Free Software Foundation."
    row = scan_licenses(frame([(1, text), (2, "nothing")])).filter("doc_id = 1").first()
    assert row["labels"] == "gpl" and row["base_labels"] == "" and row["score"] == 1.0


def test_licences_on_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    expected = {r["doc_id"]: brute_licences(r["text"]) for r in docs.collect()}
    for r in scan_licenses(docs).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == expected[r["doc_id"]]


def brute_labels(texts):
    """Labels and scores by comparing every template with every place of a text."""
    split = [words(t.encode()) for t in texts]
    df = Counter(w for t in split for w in set(t))
    idf = lambda w: math.log((len(texts) + 1) / (df[w] + 1)) + 1
    out = []
    for w in split:
        found, best, base = set(), 0.0, set()
        for t in templates():
            chains = [[i] for i in range(len(w)) if tuple(w[i : i + t.keys[0][1] - t.keys[0][0]]) == t.words[slice(*t.keys[0])]]
            for k in range(1, len(t.keys)):
                (a, b), before = t.keys[k], t.keys[k - 1][0]
                slack = max(SLACK, STRETCH * (a - before))
                for chain in chains:
                    near = [i for i in range(chain[-1] + 1, len(w)) if abs(i - chain[-1] - (a - before)) <= slack and tuple(w[i : i + b - a]) == t.words[a:b]] if len(chain) == k else []
                    chain += near[:1]
            for chain in chains:
                if len(chain) == len(t.keys):
                    found.add(t.label)
                    if t.base:
                        base.add(t.label)
                    got = 0.0
                    for i, x in enumerate(t.words):
                        k = max([k for k, (a, _) in enumerate(t.keys) if a <= i], default=0)
                        at = chain[k] + i - t.keys[k][0]
                        got += idf(x) if 0 <= at < len(w) and w[at] == x else 0.0
                    best = max(best, got / sum(map(idf, t.words)))
        for stays, goes in INSTEAD:
            if stays in found and goes not in base:
                found.discard(goes)
        out.append((",".join(sorted(found)), best))
    return out


def test_labels_and_scores(frame):
    whole = {t.label: b" ".join(t.words).decode() for t in templates()}
    mit, bsd = whole["mit"], whole["bsd-3"]
    changed = mit.replace("sublicense", "x y z").replace("merchantability", "")
    texts = [f"Copyright 2020 A\n{t}\nend" for t in whole.values()]
    texts += [mit[: len(mit) // 2], changed, f"{mit} {mit} {bsd}", mit.replace("without restriction", "word " * 40), mit.replace("without restriction", "word " * 400), "word " * 5000 + mit]
    texts += ["mit license", "under the mit license all rights reserved", "Licensed under the Apache License, Version 2.0", "", "GNU General Public License, version 3. cc by sa", "license " * 500 + "the gnu general public license version 2"]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in scan_licenses(frame(rows)).collect()}
    for (i, _), (labels, score) in zip(rows, brute_labels(texts), strict=True):
        assert got[i][0] == labels, texts[i][:80]
        assert abs(got[i][1] - score) < 1e-9
    exact = list(whole).index("mit")
    assert got[exact] == ("mit", 1.0) and 0.5 < got[len(whole) + 1][1] < 1 and got[len(whole)][0] == ""
