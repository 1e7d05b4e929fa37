"""Repeated passages across documents by distributed prefix doubling over sampled positions.

Two suffixes that agree on ``threshold`` = 2k bytes agree on k bytes and, at offset k, on k more. Names of the first
k bytes stand in for their ranks. Doubling every position of a corpus moves at least 16 bytes for each byte of text, so
the first naming sorts only *anchors*: in each window of 2k bytes the k-gram of least hash, which equal windows share.

1. Each window belongs to its anchor; an anchor with its run of windows is one record. Records are sorted by
   (k-byte name, name of the whole run). A run seen in a smaller document is removed whole; names that are unique drop out.
2. For what is left, the bytes of the run go along and every window is ranked by the pair
   (name at its start, name at offset k), at which point the prefix has reached the threshold and doubling ends.

Both sorts run in hash buckets sized by the corpus, records of equal content are merged before they are sent (within a chunk,
and for runs that many texts share within a whole task, so that a line of most documents sends a record a task), and text
moves as compressed blocks. A row is named by its doc_id and a hash of its text. Names are 80 bits besides the bucket in the first step and 128 in the second.

Defined cases: a null text is empty. A null doc_id counts as larger than any, so such rows lose what others hold but
never remove anything. Rows with one doc_id don't remove from each other; equal rows get equal results. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, cut, lean, lean_group, lean_pair, merged, mix, pack, texts, unpack, utf8

BASE_1, BASE_2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
PIECE = 1 << 20
#: Anchors that a bucket holds, and bytes of text that a block holds, about.
BUCKET_ANCHORS, BLOCK_BYTES = 700_000, 8 << 20
#: Records that are packed together, records whose windows are named at a time, and windows whose anchors are sought at a time.
PART, NAMED, SLICE = 16_000, 2_000, 1 << 18
NONE = np.iinfo(np.int64).max
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        v = np.minimum(v[: v.size - have], v[have:])
        have *= 2
    return np.minimum(v[: v.size - (width - have)], v[width - have :]) if width > have else v


def anchors(raw: np.ndarray, starts: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: name of the anchor's k-gram, name of the run, first window, windows, anchor.

    starts, counts: the windows that may be used, as runs in order that don't overlap; a run may be cut between two slices.
    """
    empty = np.zeros(0, np.int64)
    if raw.size < 2 * k or not counts.sum():
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    used = counts > 0
    starts, edge, found = starts[used], np.concatenate([[0], np.cumsum(counts[used])]), []
    for a in range(0, int(edge[-1]), SLICE):
        b = min(a + SLICE, int(edge[-1]))
        x, y = np.searchsorted(edge, a, "right") - 1, np.searchsorted(edge, b)
        begin, end = np.maximum(edge[x:y], a), np.minimum(edge[x + 1 : y + 1], b)
        first = starts[x:y] + begin - edge[x:y]
        low, high = int(first[0]), int(first[-1] + end[-1] - begin[-1]) + 2 * k - 1
        name, run, at, n, anchor = _anchors(raw[low:high], first - low, end - begin, k)
        found.append((name, run, at + low, n, anchor + low))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _anchors(raw: np.ndarray, starts: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    one, two = Rolling(raw, BASE_1), Rolling(raw, BASE_2)
    names = one.grams(k)
    least = _least((mix(names) & HIGH) | np.arange(names.size, dtype=np.uint64), k + 1)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    window = np.arange(shift.size) + shift
    owner = (least[window] & LOW).astype(np.int64)
    fresh = np.ones(window.size, bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1)
    at = np.flatnonzero(fresh)
    n = np.diff(np.append(at, window.size))
    first, anchor = window[at], owner[at]
    run = two.span(first, first + n + 2 * k - 1)
    return names[anchor], mix(run + mix((anchor - first + 64 * n).astype(np.uint64))), first, n, anchor


def _pieces(raw: np.ndarray, at: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Chunks of about PIECE bytes: bytes, rows, where each part starts in its document and in the chunk, its windows."""
    reach, rows, begins, ends, held = 2 * k - 1, [], [], [], 0
    for i, size in enumerate(np.diff(at).tolist()):
        for begin in range(0, max(size - reach, 0), PIECE):
            end = min(begin + PIECE + reach, size)
            rows.append(i)
            begins.append(begin)
            ends.append(end)
            held += end - begin
            if held >= PIECE:
                yield _piece(raw, at, rows, begins, ends, reach)
                rows, begins, ends, held = [], [], [], 0
    if rows:
        yield _piece(raw, at, rows, begins, ends, reach)


def _piece(raw, at, rows, begins, ends, reach):
    r, b, e = np.array(rows), np.array(begins), np.array(ends)
    chunk = np.concatenate([raw[at[i] + x : at[i] + y] for i, x, y in zip(rows, begins, ends, strict=True)])
    return chunk, r, b, np.concatenate([[0], np.cumsum(e - b)[:-1]]), e - b - reach


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts equal keys together, and where each key begins in it."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    return order, np.flatnonzero(np.append(True, s[1:] != s[:-1]))


def _split(keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    if not keys.size:
        return
    order, begin = _grouped(keys)
    for a, b in zip(begin, np.append(begin[1:], keys.size), strict=True):
        yield int(keys[order[a]]), [c[order[a:b]] for c in columns]


def _blocks_of(row: np.ndarray, blocks: int) -> np.ndarray:
    return (row.view(np.uint64) % np.uint64(blocks)).astype(np.int64)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


PACKED = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("payload", pa.binary())])
PACKED_DDL = "bucket long, kind int, payload binary"
RESULT = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
RESULT_DDL = "doc_id long, row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: Kinds of packed rows: records to be sorted, windows to be removed, records for the second step, documents.
SORT, GONE, MORE, TEXT = 0, 1, 2, 3
#: Texts of one chunk that share a run for it to be remembered, and runs that a task remembers.
HOT, REMEMBERED = 4, 1 << 16


def _forty(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper 40 bits, as two columns."""
    return (x >> np.uint64(32)).astype(np.uint32), (x >> np.uint64(24)).astype(np.uint8)


def _pack_runs(doc: np.ndarray, row: np.ndarray, begin: np.ndarray, n: np.ndarray) -> bytes:
    """Runs of windows by row, each row named once."""
    order = np.lexsort((begin, row, doc))
    doc, row, begin, n = doc[order], row[order], begin[order], n[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]))
    return pack(doc[new], row[new], new.astype(np.uint8), begin, n.astype(np.int64))


def _open_runs(payloads: list[bytes]) -> list[np.ndarray]:
    """Of all payloads: documents, rows, first windows, windows."""
    parts = [(d[(of := np.cumsum(new) - 1)], r[of], b, n) for d, r, new, b, n in map(unpack, payloads)]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _by_row(payloads: list[bytes]) -> Iterator[tuple[tuple[int, int], np.ndarray, np.ndarray]]:
    """(document, row), first windows and windows of each row."""
    if not payloads:
        return
    doc, row, begin, n = _open_runs(payloads)
    order = np.lexsort((begin, row, doc))
    doc, row, begin, n = doc[order], row[order], begin[order], n[order]
    at = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]))) if doc.size else doc
    for x, y in zip(at.tolist(), [*at[1:].tolist(), doc.size], strict=True) if doc.size else ():
        yield (int(doc[x]), int(row[x])), begin[x:y], n[x:y]


class Remembered:
    """Runs that many of a task's texts share, with the least document that the task has sent for each: a larger one need
    not be sent. What isn't remembered is only sent again."""

    def __init__(self):
        self.key = self.name = self.run = np.zeros(0, np.uint64)
        self.doc = np.zeros(0, np.int64)

    def _places(self, name: np.ndarray, run: np.ndarray) -> np.ndarray:
        key = name ^ mix(run.copy())
        at = np.minimum(np.searchsorted(self.key, key), max(self.key.size - 1, 0))
        if not self.key.size:
            return np.full(name.size, -1)
        return np.where((self.key[at] == key) & (self.name[at] == name) & (self.run[at] == run), at, -1)

    def least(self, name: np.ndarray, run: np.ndarray) -> np.ndarray:
        at = self._places(name, run)
        return np.where(at >= 0, self.doc[at], NONE) if self.doc.size else np.full(name.size, NONE)

    def learn(self, name: np.ndarray, run: np.ndarray, doc: np.ndarray, often: np.ndarray) -> None:
        """Distinct runs with their least document; new ones only if many texts have them."""
        at = self._places(name, run)
        known = at >= 0
        if known.any():
            np.minimum.at(self.doc, at[known], doc[known])
        new = often & ~known
        if not new.any():
            return
        if self.key.size + new.sum() > REMEMBERED:
            self.__init__()
        columns = [np.concatenate(c) for c in ((self.key, name[new] ^ mix(run[new].copy())), (self.name, name[new]), (self.run, run[new]), (self.doc, doc[new]))]
        order = np.argsort(columns[0], kind="stable")
        keep = np.append(True, columns[0][order][1:] != columns[0][order][:-1])
        self.key, self.name, self.run, self.doc = (c[order][keep] for c in columns)


def _first_step(buckets: int, blocks: int, k: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Remembered()
        for batch in batches:
            doc = batch.column(0).fill_null(NONE).to_numpy(zero_copy_only=False)
            row = batch.column(1).to_numpy(zero_copy_only=False)
            raw, at = utf8(batch.column(2))
            for chunk, rows, begins, starts, counts in _pieces(raw, at, k):
                name, run, first, n, _ = anchors(chunk, starts, counts, k)
                if not name.size:
                    continue
                part = np.searchsorted(starts, first, "right") - 1
                i, begin = rows[part], first - starts[part] + begins[part]
                # equal runs of this task: only those of the smallest document so far go on
                order = np.lexsort((doc[i], run, name))
                same = np.append(False, (name[order[1:]] == name[order[:-1]]) & (run[order[1:]] == run[order[:-1]]))
                heads, group = order[~same], np.cumsum(~same) - 1
                known = memory.least(name[heads], run[heads])
                lost = np.zeros(order.size, bool)
                lost[order] = doc[i[order]] > np.minimum(doc[i[heads]], known)[group]
                memory.learn(name[heads], run[heads], doc[i[heads]], np.bincount(group) >= HOT)
                out = []
                keep = np.flatnonzero(~lost)
                place = (mix(name[keep]) >> np.uint64(20)) % np.uint64(buckets)
                for b, (s,) in _split(place.astype(np.int64), keep):
                    of, local = np.unique(i[s], return_inverse=True)
                    out.append((b, SORT, pack(doc[of], row[of], np.diff(local, prepend=0).astype(np.int32), *_forty(name[s]), *_forty(run[s]), np.diff(begin[s], prepend=0).astype(np.int64), n[s].astype(np.uint8))))
                gone = np.flatnonzero(lost)
                for b, (s,) in _split(_blocks_of(row[i[gone]], blocks), gone):
                    out.append((-1 - b, GONE, _pack_runs(doc[i[s]], row[i[s]], begin[s], n[s])))
                if out:
                    yield _batch(PACKED, out)

    return emit


def _rank_runs(blocks: int):
    """Names of k bytes and of runs, sorted: what is removed whole, and what takes part in the second step."""

    def rank(key, group):
        b = key[0].as_py()
        if b < 0:  # nothing to sort: on its way to the documents
            return pa.Table.from_batches([_batch(PACKED, [(-1 - b, GONE, _pack_runs(*_open_runs(group.column("payload").to_pylist())))])])
        docs, rows, who, name, run, begin, n, held = [], [], [], [], [], [], [], 0
        for payload in group.column("payload"):
            d, r, of, n1, n2, r1, r2, at, count = unpack(payload.as_py())
            docs.append(d)
            rows.append(r)
            who.append(np.cumsum(of, dtype=np.int32) + np.int32(held))
            held += d.size
            name.append(n1.astype(np.uint64) << np.uint64(8) | n2)
            run.append(r1.astype(np.uint64) << np.uint64(8) | r2)
            begin.append(np.cumsum(at).astype(np.int32))  # a text has under 2**31 bytes
            n.append(count)
        docs, rows, who, begin, n = map(np.concatenate, (docs, rows, who, begin, n))
        name = np.concatenate(name)
        run = np.concatenate(run)
        doc = docs[who]
        order = np.lexsort((doc, run, name))
        doc = doc[order]
        name = name[order]
        new_name = np.append(True, name[1:] != name[:-1])
        del name
        run = run[order]
        new_run = new_name | np.append(True, run[1:] != run[:-1])
        del run
        run_at = np.flatnonzero(new_run)
        least = doc[run_at[np.cumsum(new_run) - 1]]
        lost = doc > least
        name_at = np.flatnonzero(new_name)
        several = np.add.reduceat(new_run.astype(np.int64), name_at) > 1
        several &= np.minimum.reduceat(doc, name_at) < np.maximum.reduceat(least, name_at)
        del doc, least
        more = several[np.cumsum(new_name) - 1] & ~lost
        out = []
        for kind, s in ((GONE, order[lost]), (MORE, order[more])):
            out += [(x, kind, _pack_runs(docs[who[s]], rows[who[s]], begin[s].astype(np.int64), n[s])) for x, (s,) in _split(_blocks_of(rows[who[s]], blocks), s)]
        return pa.Table.from_batches([_batch(PACKED, out)])

    return rank


def _cover(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of byte ranges."""
    if not begin.size:
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    at = np.flatnonzero(np.append(True, begin[1:] > reach[:-1]))
    return begin[at], reach[np.append(at[1:], begin.size) - 1]


def _spans(payloads: list[bytes], reach: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """By (document, row): removed byte ranges."""
    return {at: _cover(begin, begin + n + reach) for at, begin, n in _by_row(payloads)}


def _names(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    """(document, row) of each row."""
    return list(zip(batch.column(0).fill_null(NONE).to_pylist(), batch.column(1).to_pylist(), strict=True))


def _whole_characters(text: bytes, begin: np.ndarray, end: np.ndarray) -> bytes:
    """What is left if only whole characters go."""
    kept, at = [], 0
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(text[at:a])
        at = max(at, b)
    return b"".join([*kept, text[at:]])


NOWHERE = np.zeros(0, np.int64), np.zeros(0, np.int64)


def _pack_text(blocks: int):
    """Whole documents by block, compressed together."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            row = batch.column(1).to_numpy(zero_copy_only=False)
            out = []
            for b, (s,) in _split(_blocks_of(row, blocks), np.arange(row.size)):
                sink = pa.BufferOutputStream()
                part = batch.take(pa.array(s))
                with pa.ipc.new_stream(sink, part.schema) as writer:
                    writer.write_batch(part)
                out.append((b, TEXT, press.compress(sink.getvalue())))
            yield _batch(PACKED, out)

    return emit


def _open_text(docs: pa.Table) -> Iterator[pa.RecordBatch]:
    loose = zstandard.ZstdDecompressor()
    for payload in docs.column("payload"):
        yield from pa.ipc.open_stream(loose.decompress(payload.as_py()))


def _records(buckets: int, k: int):
    """The runs of a block's documents that the second step needs, with their bytes, by anchor."""

    def gather(key, docs, found):
        more = {at: runs for at, *runs in _by_row(found.column("payload").to_pylist())}
        out = []
        for batch in _open_text(docs) if more else ():
            raw, at = utf8(batch.column(2))
            doc = batch.column(0).fill_null(NONE).to_numpy(zero_copy_only=False)
            row = batch.column(1).to_numpy(zero_copy_only=False)
            i, runs = [], []
            for x, name in enumerate(_names(batch)):
                if name in more:  # equal rows: once
                    i.append(x)
                    runs.append(more.pop(name))
            if not i:
                continue
            i = np.array(i, np.int64)
            sizes = [c[0].size for c in runs]
            begin, n = np.concatenate([c[0] for c in runs]), np.concatenate([c[1] for c in runs])
            d, r, w = np.repeat(doc[i], sizes), np.repeat(row[i], sizes), begin + np.repeat(at[i], sizes)
            for s in np.array_split(np.arange(w.size), w.size // PART + 1):
                size = n[s] + 2 * k - 1
                edge = np.concatenate([[0], np.cumsum(size)])
                flat = raw[np.repeat(w[s] - edge[:-1], size) + np.arange(edge[-1])]
                names = Rolling(flat, BASE_1).grams(k)
                owner = (mix(names) & HIGH) | np.arange(names.size, dtype=np.uint64)
                # all windows of a run have the anchor of its first, which holds k + 1 grams
                head = (owner[edge[:-1, None] + np.arange(k + 1)].min(axis=1) & LOW).astype(np.int64)
                place = ((mix(names[head]) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                for b, (x,) in _split(place, np.arange(s.size)):
                    idx = np.repeat(edge[x] - np.concatenate([[0], np.cumsum(size[x])[:-1]]), size[x]) + np.arange(size[x].sum())
                    out.append((b, MORE, pack(d[s[x]], r[s[x]], begin[s[x]], n[s[x]].astype(np.uint8), (head[x] - edge[x]).astype(np.uint8), flat[idx])))
        return pa.Table.from_batches([_batch(PACKED, out)])

    return gather


def _rank_windows(blocks: int, k: int):
    """Windows of records with one anchor name, by the pair of names at their start and at offset k."""

    def rank(key, group):
        parts = [unpack(p.as_py()) for p in group.column("payload")]
        doc, row, begin, n, off, raw = (np.concatenate(c) for c in zip(*parts, strict=True))
        n, off = n.astype(np.int64), off.astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(n + 2 * k - 1)])
        window = np.concatenate([[0], np.cumsum(n)])
        one_name, next_name = np.empty(window[-1], np.uint64), np.empty(window[-1], np.uint64)
        for a in range(0, n.size, NAMED):
            b = min(a + NAMED, n.size)
            bytes_ = raw[edge[a] : edge[b]]
            one, two = Rolling(bytes_, BASE_1), Rolling(bytes_, BASE_2)
            # a record before has n + 2k - 1 bytes for its n windows
            w = np.arange(window[b] - window[a]) + np.repeat(np.arange(b - a) * (2 * k - 1), n[a:b])
            one_name[window[a] : window[b]] = mix(one.span(w, w + k)) ^ two.span(w, w + k)
            next_name[window[a] : window[b]] = one.span(w + k, w + 2 * k) + mix(two.span(w + k, w + 2 * k))
        found = []
        for o in range(k + 1):  # windows whose anchor lies o bytes in
            j = off - o
            s = np.flatnonzero((j >= 0) & (j < n))
            if s.size < 2:
                continue
            w = window[s] + j[s]
            first, rest = one_name[w], next_name[w]
            order = np.lexsort((doc[s], rest, first))
            a, b, d = first[order], rest[order], doc[s][order]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            least = d[np.flatnonzero(new)[np.cumsum(new) - 1]]
            hit = s[order[d > least]]
            found.append((doc[hit], row[hit], begin[hit] + j[hit]))
        if not found or not sum(x[0].size for x in found):
            return PACKED.empty_table()
        d, r, b = (np.concatenate(c) for c in zip(*found, strict=True))
        out = []
        for x, (d, r, b) in _split(_blocks_of(r, blocks), d, r, b):
            order = np.lexsort((b, r, d))
            d, r, b = d[order], r[order], b[order]
            at = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (b[1:] != b[:-1] + 1)))
            out.append((x, GONE, _pack_runs(d[at], r[at], b[at], np.diff(np.append(at, r.size)))))
        return pa.Table.from_batches([_batch(PACKED, out)])

    return rank


def _digests(k: int):
    def finish(key, docs, found):
        spans = _spans(found.column("payload").to_pylist(), 2 * k - 1)
        out = []
        for batch in _open_text(docs):
            for name, d, text in zip(_names(batch), batch.column(0).to_pylist(), texts(batch.column(2)), strict=True):
                begin, end = spans.get(name, NOWHERE)
                kept, at = [], 0
                for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                out.append((d, name[1], len(text), len(text) - len(kept), int(begin.size), hashlib.sha256(kept).hexdigest()))
        return pa.Table.from_batches([_batch(RESULT, out)])

    return finish


def _stripped(k: int, names: list[str]):
    """The documents' own columns, with what is left of their texts."""

    def finish(key, docs, found):
        spans = _spans(found.column("payload").to_pylist(), 2 * k - 1)
        out = []
        for batch in _open_text(docs):
            own = dict(zip(names, batch.columns[3:], strict=True))
            left = [_whole_characters(t, *spans.get(name, NOWHERE)).decode() for name, t in zip(_names(batch), texts(batch.column(2)), strict=True)]
            own["text"] = pa.array(left, pa.string())
            if "n_chars" in own:
                own["n_chars"] = pa.array([len(t) for t in left], own["n_chars"].type)
            out.append(pa.RecordBatch.from_arrays(list(own.values()), names))
        return pa.Table.from_batches(out) if out else pa.table({n: [] for n in names})

    return finish


def _repeats(docs: DataFrame, threshold: int, finish, ddl, more: list) -> DataFrame:
    assert threshold % 2 == 0 and 8 <= threshold <= 250, "the threshold is doubled from its half and must be even"
    k = threshold // 2
    known = [F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_row"), F.coalesce("text", F.lit("")).alias("_text")]
    docs, bare = docs.select(*known, *more), docs.select(*known)
    size = bare.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(8, -(-int(size * 2 / (k + 1)) // BUCKET_ANCHORS))
    blocks = max(8, -(-size // BLOCK_BYTES))
    first = cut(bare.mapInArrow(lean(_first_step(buckets, blocks, k)), PACKED_DDL).groupBy("bucket").applyInArrow(lean_group(_rank_runs(blocks)), PACKED_DDL))
    whole = docs.mapInArrow(lean(_pack_text(blocks)), PACKED_DDL).select("bucket", "payload")
    of = lambda kind: first.filter(F.col("kind") == kind).select("bucket", "payload")
    records = whole.groupBy("bucket").cogroup(of(MORE).groupBy("bucket")).applyInArrow(lean_pair(_records(buckets, k)), PACKED_DDL)
    second = records.groupBy("bucket").applyInArrow(lean_group(_rank_windows(blocks, k)), PACKED_DDL).select("bucket", "payload")
    return whole.groupBy("bucket").cogroup(of(GONE).unionByName(second).groupBy("bucket")).applyInArrow(lean_pair(finish(k)), ddl)


def remove_repeats(docs: DataFrame, threshold: int = 50) -> DataFrame:
    """Per row: doc_id, row (a hash of the text), n_bytes, n_removed, n_spans, kept_sha256."""
    return _repeats(docs, threshold, _digests, RESULT_DDL, [])


def strip_repeats(docs: DataFrame, threshold: int = 50) -> DataFrame:
    """The rows with all their columns, texts without repeats (whole characters only), n_chars following."""
    return _repeats(docs, threshold, lambda k: _stripped(k, docs.columns), docs.schema, [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
