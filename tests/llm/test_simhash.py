import time

import numpy as np
import xxhash

from stacksift.llm import simhash
from stacksift.llm.simhash import fingerprint_hex, keep_first, keys, links, near_duplicates


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if grams else 0


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = []
    for (d, _), f, g in zip(rows, fps, group, strict=True):
        ids = [rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None]
        out.append((d, format(f, "016x"), min(ids) if ids else None))
    return sorted(out, key=str)


def ours(df):
    return sorted((tuple(r) for r in near_duplicates(df).select("doc_id", fingerprint_hex().alias("fingerprint"), "component_id").collect()), key=str)


def test_odd_rows(frame, odd):
    rows = [(d, t if t is None or len(t) < 1000 else t[:400]) for d, t in odd]
    assert ours(frame(rows)) == brute(rows)


def test_long_and_empty(frame):
    assert ours(frame([])) == []
    assert ours(frame([(1, "word " * 200_000)]))[0][2] == 1


def test_against_brute_force_on_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    assert ours(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_keys_meet_within_four_bits():
    rng = np.random.default_rng(3)
    a = rng.integers(-(2**63), 2**63 - 1, 4000)
    for bits in range(1, 5):
        flips = np.array([np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, bits, replace=False).astype(np.uint64)) for _ in range(a.size)])
        b = (a.view(np.uint64) ^ flips).view(np.int64)
        (i, k), (j, m) = keys(a), keys(b)
        shared = set(zip(i.tolist(), k.tolist(), strict=True)) & set(zip(j.tolist(), m.tolist(), strict=True))
        assert {x for x, _ in shared} == set(range(a.size))


def test_code_is_perfect():
    assert (simhash.ERRORS > 0).sum() == 2047


def test_links_of_a_large_group_stay_linear():
    fp = np.arange(2000, dtype=np.int64)
    a, b = links(np.zeros(fp.size, np.uint32), fp, 4)
    assert a.size == fp.size - 1 and (b == 0).all()


def test_divided_keys_lose_no_link(monkeypatch):
    rng = np.random.default_rng(8)
    seeds = rng.integers(-(2**63), 2**63 - 1, 30)
    fp = np.unique(np.concatenate([seeds, *((np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, 4, replace=False).astype(np.uint64)) ^ seeds.view(np.uint64)).view(np.int64) for _ in range(60))]))
    fp = np.unique(np.concatenate([fp, (fp[:900].view(np.uint64) ^ np.uint64(0b1011)).view(np.int64)]))
    who, key = keys(fp)
    labels = []
    for direct in (0, 3, 10**9):
        monkeypatch.setattr(simhash, "DIRECT", direct)
        a, b = links(key, fp[who], 4)
        edge_of = dict(zip(a.tolist(), b.tolist(), strict=True))
        labels.append([edge_of.get(x, x) for x in fp.tolist()])
        assert not set(b.tolist()) & set(a.tolist())
    assert labels[0] == labels[1] == labels[2]
    near = [(i, j) for i in range(fp.size) for j in np.flatnonzero(np.bitwise_count(fp.view(np.uint64) ^ fp.view(np.uint64)[i]) <= 4)]
    assert all(labels[0][i] == labels[0][j] for i, j in near)


def test_a_hot_key_is_divided():
    rng = np.random.default_rng(9)
    fp = np.unique(rng.integers(-(2**63), 2**63 - 1, 20_000))
    began = time.time()
    links(np.zeros(fp.size, np.int64), fp, 4)
    assert time.time() - began < 5


def test_keep_first(frame, odd):
    df = frame(odd)
    got = keep_first(df)
    assert got.columns == df.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert ids.count(4) == 1 and 7 not in ids and 6 in ids
