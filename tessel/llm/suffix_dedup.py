"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier. Strings are compared as
they stand in the input. A suffix array of the whole corpus would need many sorts of all its bytes, so
the corpus is first cut into *runs* between which no comparison is needed:

1. Of the ``length - GRAM + 1`` grams in a string the one with the smallest hash (the rightmost of equal
   ones) is its anchor. It depends on the string alone, so equal strings have equal anchors at equal
   places. Consecutive strings with the same anchor form a run; a run has one gram, its anchor.
2. Runs meet by the hash of their anchor; those whose anchor occurs once are done. Within a map task runs that
   are equal as a whole, byte for byte, are settled before the shuffle, so a passage in a third of all documents
   sends a run per task.
3. The bytes of all other runs are fetched and put in suffix order, anchor by anchor. Previous and next smaller
   positions give the longest previous factor of each run; those as long as the run remove it whole. What is left of
   an anchor with several runs (the edges of passages) is done again string by string: strings whose longest previous
   factor has ``length`` bytes go. A task reduces what it holds to first runs whenever it has grown.
4. An anchor with more than ``crowd`` kinds of runs, as one in a passage that very many documents hold among other
   words, is split: its strings go on as runs of one string, with the string's own hash as the anchor, and through
   steps 2 and 3 once more. Few of them occur twice.

Hashes only decide which runs and strings meet; what goes is decided on the bytes. Runs travel as packed arrays, one
compressed row for each map batch and partition, and each part has a partition of its own. So do the texts, which
meet what is asked of them, and in the end their spans, in the part of their document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm import textbytes as T
from tessel.llm.common import small_batches, written

GRAM = 32
#: Window starts handled at once; positions in a piece fit the low bits of a packed key.
PIECE, LOW = 1 << 18, 20
#: Runs that a map task gathers before it settles the repeats among them and sends the rest.
SETTLE = 250_000
#: Strings, and runs, that are put in suffix order at once; together they take about 400 bytes each.
STRINGS, ORDERED = 25_000, 20_000
#: Bytes of runs that a task holds before it reduces them, and bytes of texts to a partition of runs.
REDUCE, SHARE = 32 << 20, 64 << 20
#: Bytes that are gathered at once; each takes 24 bytes of places meanwhile.
GATHERED = 1 << 20
#: Bytes of texts that are dealt, or met with what is asked of them, at once.
DEALT = 8 << 20
#: Longer strings would not fit a run's length, and hardly be repeated passages.
MOST_LENGTH = 1 << 15
_MASK = np.uint64((1 << LOW) - 1)
_ZSTD = pa.Codec("zstd", 1)

#: A run: anchor hash, content hash, document, first string's start, number of strings.
RUN = np.dtype([("h", "<u8"), ("r", "<u4"), ("doc", "<i8"), ("s", "<i4"), ("n", "<u2")])
SPAN = np.dtype([("doc", "<i8"), ("s", "<i4"), ("e", "<i4")])
ASK = np.dtype([("doc", "<i8"), ("h", "<u8"), ("s", "<i4"), ("n", "<u2"), ("crowded", "<u1")])
NO_ID = (1 << 63) - 1


def pieces(texts: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, offset in it, offsets, bytes): short texts together, long ones in overlapping parts."""
    for row, _, at, data in T.chunks(texts, PIECE // 2):
        if len(data) <= PIECE:
            yield row, 0, at, data
            continue
        for s in range(0, len(data) - length + 1, PIECE):
            part = data[s : s + PIECE + length - 1]
            yield row, s, np.array([0, len(part)]), part


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each ``w`` consecutive entries."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def runs_of(at: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, content hash, first start, number of strings) of the runs in the texts of a piece."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    gram = min(GRAM, length // 2)
    prefix, (_, inverse) = T.prefix_hash(data), T.powers(len(data) + 1)
    with np.errstate(over="ignore"):
        grams = T.mix((prefix[gram:] - prefix[:-gram]) * inverse[: len(data) - gram + 1])
    place = _MASK - np.arange(len(grams), dtype=np.uint64)
    least = sliding_min((grams & ~_MASK) | place, length - gram + 1)
    valid = np.ones(n + 1, bool)
    valid[n] = False
    for end in at[1:-1]:  # a string doesn't cross two texts
        valid[max(end - length + 1, 0) : end] = False
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[1:] |= ~valid[: n - 1]
    first = np.flatnonzero(new & valid[:n])
    last_of = np.flatnonzero(valid[:n] & (~valid[1:] | np.concatenate((new[1:], [True]))))
    anchor = (_MASK - (least[first] & _MASK)).astype(np.int64)
    with np.errstate(over="ignore"):
        content = T.mix(T.span_hash(prefix, first, last_of + length) + (anchor - first).astype(np.uint64))
    return grams[anchor], content, first, last_of - first + 1


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ``data`` one after the other."""
    ends = np.cumsum(sizes)
    out, i, done = np.empty(ends[-1] if len(ends) else 0, data.dtype), 0, 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, done + GATHERED, "right")))
        n = sizes[i:j]
        out[done : ends[j - 1]] = data[np.repeat(starts[i:j] - (ends[i:j] - n) + done, n) + np.arange(ends[j - 1] - done)]
        i, done = j, ends[j - 1]
    return out


def settle(runs: np.ndarray, data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(the first run of each kind, the later ones); ``data[at[i]:]`` begins with the bytes of run i.

    Runs of equal hashes lie side by side, by position; one goes if its bytes are those of the one before.
    """
    order = np.lexsort((runs["s"], runs["doc"], runs["r"], runs["h"]))
    runs, at = runs[order], at[order]
    same = np.zeros(len(runs), bool)
    same[1:] = (runs["h"][1:] == runs["h"][:-1]) & (runs["r"][1:] == runs["r"][:-1]) & (runs["n"][1:] == runs["n"][:-1])
    again = np.flatnonzero(same)
    sizes = runs["n"].astype(np.int64) + length - 1
    for i in range(0, len(again), ORDERED):
        some = again[i : i + ORDERED]
        equal = gather(data, at[some], sizes[some]) == gather(data, at[some - 1], sizes[some])
        same[some] = np.logical_and.reduceat(equal, np.cumsum(sizes[some]) - sizes[some])
    return runs[~same], runs[same]


def span_rows(runs: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(runs), SPAN)
    out["doc"], out["s"] = runs["doc"], runs["s"]
    out["e"] = runs["s"].astype(np.int64) + runs["n"] + length - 1
    return out


def spread(keys: np.ndarray, parts: int) -> np.ndarray:
    return (T.mix(keys.astype(np.uint64, copy=False)) % np.uint64(parts)).astype(np.int64)


def pressed(data: bytes) -> bytes:
    """``data`` compressed, with its length in front."""
    return len(data).to_bytes(4, "little") + _ZSTD.compress(data, asbytes=True)


def plain(blob: bytes) -> bytes:
    return _ZSTD.decompress(blob[4:], int.from_bytes(blob[:4], "little"), asbytes=True)


def packed(kind: int, rows: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(kind, part, rows of the part), fields stored one after the other so that they compress."""
    if not len(rows):
        return
    order = np.lexsort((rows["s"], rows["doc"], part))
    rows, part = rows[order], part[order]
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    for s, e in zip(cuts, [*cuts[1:], len(rows)], strict=True):
        yield kind, int(part[s]), pressed(b"".join(np.ascontiguousarray(rows[f][s:e]).tobytes() for f in rows.dtype.names))


def unpacked(blobs: list[bytes], dtype: np.dtype) -> np.ndarray:
    sizes = [int.from_bytes(b[:4], "little") // dtype.itemsize for b in blobs]
    out, at = np.empty(sum(sizes), dtype), 0
    for blob, n in zip(blobs, sizes, strict=True):
        b, start = plain(blob), 0
        for name in dtype.names:
            out[name][at : at + n] = np.frombuffer(b, dtype[name], n, start)
            start += n * dtype[name].itemsize
        at += n
    return out


PACKED = "kind int, part int, data binary"


def packed_batch(rows) -> pa.RecordBatch:
    kinds, parts, data = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(parts, pa.int32()), pa.array(data, pa.binary())], ["kind", "part", "data"])


RUNS, SPANS, ASKS, TEXTS = 0, 1, 2, 3


def dealt(docs: DataFrame, parts: int) -> DataFrame:
    """The texts of ``docs`` (doc, text) as packed rows, by the part of their document."""

    def packed_texts(ids: list[np.ndarray], sizes: list[np.ndarray], texts: list[np.ndarray]) -> pa.RecordBatch:
        ids, sizes, data, rows = np.concatenate(ids), np.concatenate(sizes), np.concatenate(texts), []
        part, starts = spread(ids, parts), np.cumsum(sizes) - sizes
        order = np.argsort(part, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            head = np.concatenate(([len(some)], ids[some], sizes[some])).astype("<i8")
            rows.append((TEXTS, int(part[some[0]]), pressed(head.tobytes() + gather(data, starts[some], sizes[some]).tobytes())))
        return packed_batch(rows)

    def deal(batches):
        ids, sizes, texts, held = [], [], [], 0
        for b in batches:
            docs = b["doc"].to_numpy()
            for row, stop, at, data in T.chunks(b["text"]):
                ids.append(docs[row:stop])
                sizes.append(np.diff(at))
                texts.append(data.copy())
                held += len(data) + 16 * (stop - row)
                if held >= DEALT:
                    yield packed_texts(ids, sizes, texts)
                    ids, sizes, texts, held = [], [], [], 0
        if ids:
            yield packed_texts(ids, sizes, texts)

    return docs.select("doc", "text").mapInArrow(deal, PACKED)


def met_texts(batches, dtype: np.dtype, merge=lambda rows: rows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, offsets, bytes, rows, row's text) of some texts of a part and the packed rows of their documents.

    Until all rows are there the texts wait, packed.
    """
    rows, texts = [], []
    for b in batches:
        for kind, data in zip(b["kind"].to_pylist(), b["data"].to_pylist(), strict=True):
            (texts if kind == TEXTS else rows).append(data)
    rows = merge(unpacked(rows, dtype))
    rows = rows[np.argsort(rows["doc"], kind="stable")]
    texts.reverse()
    while texts:
        some, size = [], 0
        while texts and size < DEALT:
            some.append(dealt_texts(texts.pop()))
            size += len(some[-1][2])
        ids, sizes, data = (np.concatenate(x) for x in zip(*some, strict=True))
        low, high = np.searchsorted(rows["doc"], ids), np.searchsorted(rows["doc"], ids, "right")
        text = np.repeat(np.arange(len(ids)), high - low)
        at = np.arange(len(text)) - np.repeat(np.cumsum(high - low) - high, high - low)
        yield ids, np.concatenate(([0], np.cumsum(sizes))), data, rows[at], text


def dealt_texts(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, sizes, bytes) of a packed row of texts."""
    data = plain(blob)
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(data, "<i8", n, 8), np.frombuffer(data, "<i8", n, 8 + 8 * n), np.frombuffer(data, np.uint8, offset=8 + 16 * n)


def previous_smaller(position: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in suffix order: the nearest place before it with a smaller position (or -1), and the
    length of the prefix that both share.

    All places move at once; a place that points to a larger position takes over where that one points,
    since everything in between is larger still.
    """
    n = len(position)
    to, shared = np.arange(n) - 1, np.concatenate(([0], lcp[1:])) if n else lcp
    active = np.flatnonzero((to >= 0) & (position[to] > position))
    while len(active):
        over = to[active]
        shared[active] = np.minimum(shared[active], shared[over])
        to[active] = to[over]
        active = active[(to[active] >= 0)]
        active = active[position[to[active]] > position[active]]
    shared[to < 0] = 0
    return to, shared


def longest_previous(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """LPF by place in suffix order: the longest prefix shared with a suffix at a smaller position.

    ``lcp[i]`` is of the places i - 1 and i (``lcp[0]`` is not read).
    """
    _, before = previous_smaller(position, lcp)
    back = np.concatenate(([0], lcp[1:][::-1]))
    _, after = previous_smaller(position[::-1], back)
    return np.maximum(before, after[::-1])


def by_position(docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    position = np.empty(len(docs), np.int64)
    position[np.lexsort((starts, docs))] = np.arange(len(docs))
    return position


def in_suffix_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of equally wide rows of bytes; ``lcp[i]`` is of the places i - 1 and i."""
    width = rows.shape[1]
    order = np.argsort(np.ascontiguousarray(rows).reshape(-1).view(f"S{width}"), kind="stable")
    rows = rows[order]
    lcp = np.full(len(rows), width)
    unequal = rows[1:] != rows[:-1]
    differs = unequal.any(axis=1)
    lcp[1:][differs] = unequal[differs].argmax(axis=1)
    return order, lcp


def anchor_bytes(asks: np.ndarray) -> np.ndarray:
    return asks["h"].astype(">u8").view(np.uint8).reshape(-1, 8)


def anchor_groups(asks: np.ndarray, weight: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of ``asks``, sorted by anchor, of about ``most`` in weight; an anchor's runs stay together."""
    total = np.cumsum(weight)
    edge = np.flatnonzero(np.concatenate(([True], asks["h"][1:] != asks["h"][:-1])))
    group = (total[edge] - weight[edge]) // most
    cuts = edge[np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))]
    for s, e in zip(cuts, [*cuts[1:], len(asks)], strict=True):
        yield slice(s, e)


def repeated_runs(asks: np.ndarray, starts: np.ndarray, texts: np.ndarray, length: int) -> np.ndarray:
    """Whether each run occurs as a whole in an earlier one under the same anchor.

    ``texts`` holds the bytes of run i from ``starts[i]`` on. Runs are compared as suffixes of their documents, as far
    as they reach, with the anchor's hash before them.
    """
    sizes = asks["n"].astype(np.int64) + length - 1
    place = np.arange(sizes.max())
    rows = np.zeros((len(asks), 8 + len(place)), np.uint8)
    rows[:, :8] = anchor_bytes(asks)
    inside = place < sizes[:, None]
    rows[:, 8:][inside] = gather(texts, starts, sizes)
    order, lcp = in_suffix_order(rows)
    reach = 8 + sizes[order]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(reach[1:], reach[:-1]))  # what stands beyond a run's end is not its own
    gone = np.empty(len(asks), bool)
    gone[order] = longest_previous(by_position(asks["doc"], asks["s"])[order], lcp) >= reach
    return gone


def repeated_strings(asks: np.ndarray, starts: np.ndarray, texts: np.ndarray, length: int) -> np.ndarray:
    """Spans of the strings of the runs ``asks`` that occur earlier under the same anchor; as :func:`repeated_runs`."""
    n = asks["n"].astype(np.int64)
    run = np.repeat(np.arange(len(asks)), n)
    shift = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    view = np.lib.stride_tricks.sliding_window_view(texts, length)
    strings = np.empty((len(run), 8 + length), np.uint8)
    strings[:, :8] = anchor_bytes(asks)[run]
    strings[:, 8:] = view[starts[run] + shift]
    start = asks["s"][run] + shift
    order, lcp = in_suffix_order(strings)
    gone = order[longest_previous(by_position(asks["doc"][run], start)[order], lcp) >= 8 + length]
    out = np.empty(len(gone), SPAN)
    out["doc"], out["s"] = asks["doc"][run[gone]], start[gone]
    out["e"] = out["s"] + length
    return joined(out)


def joined(spans: np.ndarray) -> np.ndarray:
    """Overlapping and touching spans of each document made one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["e"], spans["s"], spans["doc"]))]
    _, doc = np.unique(spans["doc"], return_inverse=True)
    base = doc.astype(np.int64) << 32  # so that one running maximum serves all documents
    reach = np.maximum.accumulate(base + spans["e"])
    new = np.concatenate(([True], (base + spans["s"])[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    out = spans[at].copy()
    out["e"] = reach[np.concatenate((at[1:], [len(spans)])) - 1] - base[at]
    return out


def repeated_spans(docs: DataFrame, length: int, crowd: int, parts: int) -> DataFrame:
    """Packed rows of the spans that go, by the part of their document; they may overlap.

    ``docs`` has doc (long, unique, in document order) and text, without nulls. ``parts`` is the number of partitions.
    """

    def settled(found: list[np.ndarray], data: list[np.ndarray], at: list[np.ndarray]) -> pa.RecordBatch:
        first, later = settle(np.concatenate(found), np.concatenate(data), np.concatenate(at), length)
        gone = joined(span_rows(later, length))
        return packed_batch([*packed(RUNS, first, spread(first["h"], parts)), *packed(SPANS, gone, spread(gone["doc"], parts))])

    def cut(batches):
        found, data, places, held, size = [], [], [], 0, 0
        for b in batches:
            ids = b["doc"].to_numpy()
            for row, offset, at, part in pieces(b["text"], length):
                h, r, s, n = runs_of(at, part, length)
                if not len(h):
                    continue
                runs = np.empty(len(h), RUN)
                doc = np.searchsorted(at, s, "right") - 1
                runs["h"], runs["r"], runs["doc"], runs["s"], runs["n"] = h, r, ids[row + doc], s - at[doc] + offset, n
                found.append(runs)
                data.append(part)
                places.append(s + size)
                held += len(runs)
                size += len(part)
            if held >= SETTLE:
                yield settled(found, data, places)
                found, data, places, held, size = [], [], [], 0, 0
        if found:
            yield settled(found, data, places)

    def sorted_rows(batches, wanted: int) -> tuple[list, list]:
        """(packed rows of the kind, rows of other kinds)."""
        mine, through = [], []
        for b in batches:
            for kind, part, data in zip(*(b[c].to_pylist() for c in ("kind", "part", "data")), strict=True):
                mine.append(data) if kind == wanted else through.append((kind, part, data))
        return mine, through

    def meet(batches, split: bool = True):
        """Runs whose anchor occurs several times ask for their bytes."""
        found, through = sorted_rows(batches, RUNS)
        if through:
            yield packed_batch(through)
        runs = unpacked(found, RUN)
        runs = runs[np.lexsort((runs["r"], runs["h"]))]
        twice = np.zeros(len(runs), bool)
        twice[1:] = runs["h"][1:] == runs["h"][:-1]
        twice[:-1] |= twice[1:].copy()
        runs = runs[twice]
        asks = np.zeros(len(runs), ASK)
        for f in ("doc", "h", "s", "n"):
            asks[f] = runs[f]
        if split and len(runs):
            new = np.ones(len(runs), bool)
            new[1:] = (runs["h"][1:] != runs["h"][:-1]) | (runs["r"][1:] != runs["r"][:-1])
            _, where = np.unique(runs["h"], return_inverse=True)
            asks["crowded"] = np.bincount(where, new)[where] > crowd
        yield packed_batch(list(packed(ASKS, asks, spread(asks["doc"], parts))))

    def meet_strings(batches):
        return meet(batches, split=False)

    def fetch(batches):
        """Bytes of plain runs go to their anchor's part; crowded ones become runs of one string."""
        for _, at, data, asks, text in met_texts(batches, ASK):
            starts = at[text] + asks["s"]
            sizes = asks["n"].astype(np.int64) + length - 1
            out, whole = [], np.flatnonzero(asks["crowded"] == 0)
            part = spread(asks["h"][whole], parts)
            order = np.argsort(part, kind="stable")
            whole, part = whole[order], part[order]
            cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(whole) else []
            for s, e in zip(cuts, [*cuts[1:], len(whole)], strict=True) if len(whole) else ():
                mine = whole[s:e]
                out.append((ASKS, int(part[s]), pressed(len(mine).to_bytes(4, "little") + asks[mine].tobytes() + gather(data, starts[mine], sizes[mine]).tobytes())))
            crowded = np.flatnonzero(asks["crowded"])
            for i in range(0, len(crowded), ORDERED):
                mine = crowded[i : i + ORDERED]
                body, n = gather(data, starts[mine], sizes[mine]), asks["n"][mine].astype(np.int64)
                run = np.repeat(np.arange(len(mine)), n)
                shift = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
                s = (np.cumsum(sizes[mine]) - sizes[mine])[run] + shift
                prefix = T.prefix_hash(body)
                runs = np.empty(len(run), RUN)
                runs["h"] = T.span_hash(prefix, s, s + length)
                runs["r"] = T.mix(T.span_hash(prefix, s, s + length // 2) + asks["h"][mine][run])
                runs["doc"], runs["s"], runs["n"] = asks["doc"][mine][run], asks["s"][mine][run] + shift, 1
                first, later = settle(runs, body, s, length)
                gone = joined(span_rows(later, length))
                out += [*packed(RUNS, first, spread(first["h"], parts)), *packed(SPANS, gone, spread(gone["doc"], parts))]
            if out:
                yield packed_batch(out)

    def suffixes(batches):
        """Runs and strings that occur earlier, as spans."""
        held, size, kept = [], 0, 0

        def reduced(held):
            """(the runs that stay, the spans of the others)."""
            asks, texts = np.concatenate([a for a, _ in held]), np.concatenate([t for _, t in held])
            held.clear()
            sizes = asks["n"].astype(np.int64) + length - 1
            starts = np.cumsum(sizes) - sizes
            order = np.argsort(asks["h"], kind="stable")
            asks, starts, sizes = asks[order], starts[order], sizes[order]
            gone = np.zeros(len(asks), bool)
            for some in anchor_groups(asks, np.ones(len(asks), np.int64), ORDERED):
                gone[some] = repeated_runs(asks[some], starts[some], texts, length)
            return (asks[~gone], gather(texts, starts[~gone], sizes[~gone])), joined(span_rows(asks[gone], length))

        for b in batches:
            through = []
            for kind, part, data in zip(*(b[c].to_pylist() for c in ("kind", "part", "data")), strict=True):
                if kind == ASKS:
                    data = plain(data)
                    n = int.from_bytes(data[:4], "little")
                    held.append((np.frombuffer(data, ASK, n, 4), np.frombuffer(data, np.uint8, offset=4 + n * ASK.itemsize)))
                    size += len(data)
                else:
                    through.append((kind, part, data))
            if through:
                yield packed_batch(through)
            if size > max(REDUCE, 2 * kept):
                first, gone = reduced(held)
                held, size, kept = [first], len(first[1]), len(first[1])
                yield packed_batch(list(packed(SPANS, gone, spread(gone["doc"], parts))))
        if not held:
            return
        (asks, texts), gone = reduced(held)
        yield packed_batch(list(packed(SPANS, gone, spread(gone["doc"], parts))))
        if not len(asks):
            return
        sizes = asks["n"].astype(np.int64) + length - 1
        starts = np.cumsum(sizes) - sizes
        several = np.zeros(len(asks), bool)  # anchors are in order
        several[1:] = asks["h"][1:] == asks["h"][:-1]
        several[:-1] |= several[1:].copy()
        asks, starts = asks[several], starts[several]
        for some in anchor_groups(asks, asks["n"].astype(np.int64), STRINGS) if len(asks) else ():
            gone = repeated_strings(asks[some], starts[some], texts, length)
            if len(gone):
                yield packed_batch(list(packed(SPANS, gone, spread(gone["doc"], parts))))

    def with_bytes(met: DataFrame) -> DataFrame:
        """What :func:`fetch` makes of the runs that ask, written."""
        # Most documents share an anchor with others, so all texts are dealt, packed; a join would shuffle them as they are.
        return met.where(F.col("kind") == ASKS).unionByName(dealt(docs, parts)).repartitionById(parts, "part").mapInArrow(fetch, PACKED)

    met = written(docs.select("doc", "text").mapInArrow(cut, PACKED).repartitionById(parts, "part").mapInArrow(meet, PACKED), "suffix-runs")
    spans = met.where(F.col("kind") == SPANS)
    if met.where(F.col("kind") == ASKS).limit(1).count():
        # The strings of crowded anchors pass through and meet by their own hashes; few ask once more.
        first = written(with_bytes(met).repartitionById(parts, "part").mapInArrow(suffixes, PACKED), "suffix-spans")
        spans = spans.unionByName(first.where(F.col("kind") == SPANS))
        if first.where(F.col("kind") == RUNS).limit(1).count():
            met = written(first.where(F.col("kind") == RUNS).repartitionById(parts, "part").mapInArrow(meet_strings, PACKED), "suffix-crowded")
            spans = spans.unionByName(met.where(F.col("kind") == SPANS))
            if met.where(F.col("kind") == ASKS).limit(1).count():
                spans = spans.unionByName(written(with_bytes(met).repartitionById(parts, "part").mapInArrow(suffixes, PACKED), "suffix-strings"))
    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, crowd: int = 1024, parts: int | None = None, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the bytes left) per row of ``docs``.

    Documents go by id; a byte goes if some string of ``length`` bytes over it starts in an earlier
    document or earlier in the same one. Matches don't cross documents; offsets are in UTF-8 bytes.

    * A null text is empty. Null ids come last. Rows of one id but different texts are ordered by a
      hash of the text; rows that repeat both are one document and get equal results.
    * Texts shorter than ``length`` lose nothing. An empty table gives no rows.
    * What goes is decided on bytes; hashes only say what is compared. ``length`` is 2 to 32,768. Texts may have up to 2 GiB.
    * Other columns are not read. ``parts`` is the number of partitions of runs and texts, by default one for each
      :data:`SHARE` bytes of text, and 64 at least.
    """
    if not 2 <= length <= MOST_LENGTH:
        raise ValueError(f"length must be 2 to {MOST_LENGTH}")
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = base.groupBy("doc_id").count()
    keyed = None
    if ids.where("count > 1 or doc_id is null").limit(1).count():
        # Unique keys in document order for tables whose ids are not.
        keyed = written(base.select("doc_id", F.xxhash64("text").alias("digest")).distinct().orderBy(F.col("doc_id").asc_nulls_last(), "digest").withColumn("doc", F.monotonically_increasing_id()), "suffix-keys")
        keyed = keyed.withColumnsRenamed({"doc_id": "k_id", "digest": "k_digest"})
        base = base.join(keyed, base["doc_id"].eqNullSafe(F.col("k_id")) & (F.xxhash64("text") == F.col("k_digest"))).select("doc_id", "doc", "text")
        unique = base.dropDuplicates(["doc"])
    else:
        base = unique = base.select("doc_id", F.col("doc_id").alias("doc"), "text")
    if not parts:
        parts = max(64, -(-(unique.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARE))
    spans = repeated_spans(unique, length, crowd, parts)
    met = spans.unionByName(dealt(base, parts)).repartitionById(parts, "part")

    def left(batches):
        for ids, at, data, spans, text in met_texts(batches, SPAN, joined):
            first, rows = np.searchsorted(text, np.arange(len(ids) + 1)), []
            for i, (low, high) in enumerate(zip(first[:-1], first[1:], strict=True)):
                whole, gone = data[at[i] : at[i + 1]].tobytes(), spans[low:high]
                edges = [0, *np.stack([gone["s"], gone["e"]], 1).ravel().tolist(), len(whole)]
                kept = b"".join(whole[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(whole), len(whole) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
            columns = zip(*rows, strict=True) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    names, types = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 3 + [pa.string()]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if keep_text:
        names, types, schema = [*names, "kept"], [*types, pa.binary()], schema + ", kept binary"
    out = met.mapInArrow(left, schema)
    if keyed is None:
        return out
    out = out.withColumnRenamed("doc_id", "out_doc")
    return out.join(keyed, F.col("out_doc") == F.col("doc")).select(F.col("k_id").alias("doc_id"), *names[1:])
