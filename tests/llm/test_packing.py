import bisect
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stacksift.llm.packing import best_fit, cuts, full_encoder, pack_sequences, rank_file


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def verify(rows, documents, capacity=1024):
    by_sequence, by_document = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_document[r["doc_id"]].append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, ids in documents.items():
        at = 0
        for n, r in enumerate(sorted(by_document[doc], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at)
            assert n == 0 or r["length"] == capacity
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    return len(by_sequence)


def bins_one_by_one(lengths, capacity):
    rooms, n = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms.pop(at)
        else:
            room, n = capacity, n + 1
        if room > length:
            bisect.insort(rooms, room - length)
    return n


def test_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    t = tokenizer()
    ids = {r["doc_id"]: [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    rows = pack_sequences(docs).collect()
    assert verify(rows, ids) == bins_one_by_one([r["length"] for r in rows], 1024)


def test_odd_rows(frame, odd):
    rows = [(i, t) for i, (_, t) in enumerate(odd)]
    t = tokenizer()
    got = pack_sequences(frame(rows)).collect()
    verify(got, {d: [*t.encode(x or "", add_special_tokens=False).ids, 2] for d, x in rows})
    assert len(pack_sequences(frame([(None, None), (None, None), (1, "a"), (1, "a")])).collect()) == 4
    assert pack_sequences(frame([])).collect() == []


def test_rank_file_gives_the_same_ids():
    t, ours = tokenizer(), full_encoder(rank_file())
    for text in ("", " ", "  a\n\n\tb ", "Żółw <|endoftext|> 猫 don't", "x" * 3000, "é́    end", "1234567 !!! ###"):
        assert t.encode(text, add_special_tokens=False).ids == ours(text)


@given(st.lists(st.integers(1, 30), max_size=80))
def test_plan_is_best_fit_decreasing(lengths):
    histogram = {x: lengths.count(x) for x in set(lengths)}
    plan, bins = best_fit(histogram, 30)
    assert bins == bins_one_by_one(lengths, 30)
    used = defaultdict(list)
    for length in histogram:
        own = plan[plan[:, 0] == length]
        for n in range(histogram[length]):
            _, at, first, each, offset = own[own[:, 1] <= n][-1]
            used[first + (n - at) // each].append((offset + (n - at) % each * length, length))
    assert len(used) == bins
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 30


def test_cuts():
    assert cuts(1, 4) == [(0, 1)]
    assert cuts(4, 4) == [(0, 4)]
    assert cuts(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_added_tokens_have_their_ids(frame):
    t, ours = tokenizer(), full_encoder(rank_file())
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"x{end}{end}  y\n{end}", f"don't {end[:-1]}", f"z  {end}  q", f"Żółw {end} 猫", "plain"]
    ids = {n: t.encode(x, add_special_tokens=False).ids for n, x in enumerate(texts)}
    assert ids == {n: ours(x) for n, x in enumerate(texts)}
    assert ids[0] == [64, 220, 50256, 275]
    verify(pack_sequences(frame(list(enumerate(texts)))).collect(), {n: [*x, 2] for n, x in ids.items()})
