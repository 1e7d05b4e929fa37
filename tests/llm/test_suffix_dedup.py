import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from stacksift.llm import suffix_dedup
from stacksift.llm.suffix_dedup import remove_repeats, strip_repeats


def brute(rows, threshold=50):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - threshold + 1):
            w = b[i : i + threshold]
            least[w] = min(least.get(w, float("inf")), float("inf") if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - threshold + 1):
            if least[b[i : i + threshold]] < (float("inf") if d is None else d):
                gone[i : i + threshold] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(np.sum(gone & ~np.append(False, gone[:-1]))) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def ours(df, **how):
    return sorted((tuple(r)[:1] + tuple(r)[2:] for r in remove_repeats(df, **how).collect()), key=str)


def test_odd_rows(frame, odd):
    assert ours(frame(odd)) == brute(odd)


def test_empty_table(frame):
    assert ours(frame([])) == []


def test_against_brute_force_on_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert ours(docs) == brute(rows)


@pytest.mark.parametrize("threshold", [8, 20])
def test_small_alphabet(frame, threshold):
    rng = np.random.default_rng(threshold)
    rows = [(i, "".join(rng.choice(list("ab "), int(rng.integers(0, 300))))) for i in range(40)]
    assert ours(frame(rows), threshold=threshold) == brute(rows, threshold)


def test_pieces_of_long_texts(frame, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 200)
    raw = np.frombuffer(("abcdefgh" * 100 + "The band plays on and nobody minds at all, they say." * 9).encode(), np.uint8)
    k = 25
    seen = 0
    for chunk, _, begins, starts, counts in suffix_dedup._pieces(raw, np.array([0, raw.size]), k):
        name, run, first, n, anchor = suffix_dedup.anchors(chunk, starts, counts, k)
        assert (n > 0).all() and (anchor >= first).all() and (anchor <= first + n - 1 + k).all()
        seen += int(n.sum())
    assert seen == raw.size - 2 * k + 1


def test_strip_keeps_columns_and_characters(frame, odd):
    df = frame(odd)
    got = strip_repeats(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert len(rows) == len(odd)
    assert all(r["n_chars"] == len(r["text"]) and r["row"] == "r" for r in rows)
    assert next(r["text"] for r in rows if r["doc_id"] == 8) == "é" * 500
    assert next(r["text"] for r in rows if r["doc_id"] == 7) == ""


def test_repeated_rows_apart(frame):
    rng = np.random.default_rng(3)
    once = [(i, "".join(rng.choice(list("ab "), int(rng.integers(50, 300))))) for i in range(40)]
    rows = once + once[::-1]  # A, B, A: the rows between have partial repeats
    assert ours(frame(rows).coalesce(1), threshold=8) == brute(rows, 8)


def test_shared_lines_over_many_chunks(frame, monkeypatch):
    line = "a line that nearly all of the documents hold, and that is longer than fifty bytes\n"
    other = "another one, held by a good part of them, with some words more at its very end\n"
    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(list("abc "), 30)) + line + ("x" * int(rng.integers(0, 9)) + other if i % 3 else "")) for i in rng.permutation(200).tolist()]
    rows += [(int(i), line * 3) for i in rng.integers(0, 300, 20)] + [(None, line)]
    expected = brute(rows)
    for pieces, hot, remembered in ((1 << 20, 4, 1 << 16), (600, 2, 1 << 16), (600, 2, 3)):
        for name, value in (("PIECE", pieces), ("HOT", hot), ("REMEMBERED", remembered)):
            monkeypatch.setattr(suffix_dedup, name, value)
        assert sent(rows) == expected
    assert ours(frame(rows)) == expected


def sent(rows, k=25):
    """The steps in this process, so that their settings hold."""
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([hash(t) & (1 << 62) - 1 for _, t in rows], pa.int64()), pa.array([t for _, t in rows])], ["_doc", "_row", "_text"])
    halves = [batch.slice(0, len(rows) // 2), batch.slice(len(rows) // 2)]
    groups = lambda tables: {b: (t := pa.Table.from_batches(tables)).filter(pc.equal(t["bucket"], b)) for b in set(pa.Table.from_batches(tables)["bucket"].to_pylist())}
    first = [x for h in halves for x in suffix_dedup._first_step(3, 2, k)(iter([h]))]
    ranked = [x for b, g in groups(first).items() for x in suffix_dedup._rank_runs(2)((pa.scalar(b),), g).to_batches()]
    whole = groups(list(suffix_dedup._pack_text(2)(iter(halves))))
    whole_of = lambda tables: pa.Table.from_batches(tables, suffix_dedup.PACKED)
    of = lambda kind, b, tables: whole_of(tables).filter(pc.and_(pc.equal(whole_of(tables)["kind"], kind), pc.equal(whole_of(tables)["bucket"], b)))
    records = [x for b, t in whole.items() for x in suffix_dedup._records(3, k)(None, t, of(suffix_dedup.MORE, b, ranked)).to_batches()]
    second = [x for b, g in groups(records).items() for x in suffix_dedup._rank_windows(2, k)(None, g).to_batches()] if records and sum(r.num_rows for r in records) else []
    out = [r for b, t in whole.items() for r in suffix_dedup._digests(k)(None, t, of(suffix_dedup.GONE, b, ranked + second)).to_pylist()]
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out), key=str)


@pytest.mark.parametrize(("windows", "records"), [(1, 1), (70, 3), (1000, 16_000)])
def test_slices(monkeypatch, windows, records):
    monkeypatch.setattr(suffix_dedup, "SLICE", windows)
    monkeypatch.setattr(suffix_dedup, "NAMED", records)
    rng = np.random.default_rng(7)
    parts = ["".join(rng.choice(list("abcdé "), int(rng.integers(20, 120)))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(parts, int(rng.integers(0, 6))))) for i in range(40)] + [(None, parts[0] + parts[1])]
    assert sent(rows) == brute(rows)


def traced(f):
    tracemalloc.start()
    f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_memory_of_steps():
    rng = np.random.default_rng(8)
    k, size = 25, 1 << 21
    raw = rng.integers(97, 123, size).astype(np.uint8)
    starts, counts = np.array([0]), np.array([size - 2 * k + 1])
    for base in (suffix_dedup.BASE_1, suffix_dedup.BASE_2):
        suffix_dedup.Rolling(raw, base)  # powers are kept
    assert traced(lambda: suffix_dedup.anchors(raw, starts, counts, k)) < 30 * size
    records, n = 30_000, 13
    some = rng.integers(97, 123, (records, n + 2 * k - 1)).astype(np.uint8)
    ids = np.arange(records)
    payload = suffix_dedup.pack(ids, ids, ids * 0, np.full(records, n, np.uint8), np.full(records, 20, np.uint8), some.ravel())
    group = pa.Table.from_batches([suffix_dedup._batch(suffix_dedup.PACKED, [(0, suffix_dedup.MORE, payload)])])
    assert traced(lambda: suffix_dedup._rank_windows(2, k)(None, group)) < 16 * some.size
    payload = suffix_dedup.pack(ids, ids, np.append(0, np.diff(ids)).astype(np.int32), *suffix_dedup._forty(rng.integers(0, 1 << 63, records).astype(np.uint64)), *suffix_dedup._forty(rng.integers(0, 1 << 63, records).astype(np.uint64)), ids * 0, np.full(records, n, np.uint8))
    group = pa.Table.from_batches([suffix_dedup._batch(suffix_dedup.PACKED, [(0, suffix_dedup.SORT, payload)] * 20)])
    assert traced(lambda: suffix_dedup._rank_runs(2)((pa.scalar(0),), group)) < 114 * 20 * records
