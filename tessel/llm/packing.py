"""Best-fit packing with Martello-Toth dominance reduction.

Pieces of equal length are interchangeable, so the instance is the histogram of lengths: at most
``capacity`` numbers, whatever the input. On it, sets that provably dominate all alternatives are fixed
(:func:`reduce_dominated`), and what is left goes by best fit decreasing (:func:`best_fit`). Both
give patterns (contents of a sequence) with their numbers. The n-th piece of each length, counted by
a salted rank, then finds its sequence and place in a table of as many rows as the patterns have parts.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import BATCH_ROWS, salted_rank, small, small_batches, written

#: Latin-1, lower case: the tokenizer's letters and digits (fixed by the pre-tokenizer's pattern).
_LETTERS = bytes(c for c in range(256) if chr(c).isalpha())
_DIGITS = b"0123456789"
_UPPER = bytes.maketrans(bytes(c for c in range(256) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 256), bytes(ord(chr(c).lower()) for c in range(256) if len(chr(c).lower()) == 1 and ord(chr(c).lower()) < 256))
_OTHER = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")
_PLAIN = _LETTERS + _DIGITS + _OTHER + b" \t\n\r"
_PARTS = re.compile(rb"[" + re.escape(_LETTERS) + rb"]+|[0-9]|[" + re.escape(_OTHER) + rb"]+")
_SPECIAL = re.compile(r"<\|(?:start|end)oftext\|>")
#: Entries of a worker's memo of words; beyond it the memo starts anew. It changes no result.
MEMO = 400_000

_coders: dict[str, tuple] = {}


class Coder:
    """Token ids of texts, as little-endian 32-bit bytes, with a memo of the words' ids.

    The tokenizer drops white space and never looks across it, so a text's ids are those of its parts
    between white space; in plain Latin-1 text without an apostrophe also those of its runs of letters,
    single digits and runs of other characters. Every part is encoded by the tokenizer itself.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.chunks = Tokenizer.from_file(path), {}, {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    @staticmethod
    def parts(text: str) -> tuple[list[bytes], str]:
        try:
            plain = text.encode("latin-1").translate(_UPPER)
        except UnicodeEncodeError:
            return text.encode().split(), "utf-8"
        if not plain.translate(None, _PLAIN) and not _SPECIAL.search(text):
            return _PARTS.findall(plain), "latin-1"
        return text.encode().split(), "utf-8"

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.parts(t) for t in texts]
        words = set().union(*(p for p, kind in split if kind == "latin-1"))
        chunks = set().union(*(p for p, kind in split if kind == "utf-8"))
        if len(self.words) > MEMO:
            self.words.clear()
        if len(self.chunks) > MEMO // 10:
            self.chunks.clear()
        # The batch's own words in a table of their own, which stays in the processor's caches while all texts look them up.
        here = dict(zip(words, map(self.words.get, words), strict=True))
        if new := [w for w, ids in here.items() if ids is None]:
            coded = dict(zip(new, self._words(new), strict=True))
            here.update(coded)
            self.words.update(coded)
        if new := list(chunks.difference(self.chunks)):
            coded = self.tokenizer.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)
            self.chunks.update((p, np.asarray(e.ids, "<u4").tobytes()) for p, e in zip(new, coded, strict=True))
        at = {"latin-1": here.__getitem__, "utf-8": self.chunks.__getitem__}
        return [b"".join(map(at[kind], parts)) for parts, kind in split]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of single words, a thousand to a call; the vocabulary marks the last id of each word."""
        out: list[bytes] = []
        for i in range(0, len(words), 1000):
            some = words[i : i + 1000]
            ids = np.asarray(self.tokenizer.encode(b" ".join(some).decode("latin-1"), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
                out += [raw[s:e] for s, e in zip(cuts, cuts[1:], strict=False)]
            else:
                out += [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch([w.decode("latin-1") for w in some], add_special_tokens=False)]
        return out


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 (and ids, little-endian)."""
    end, size = np.asarray([separator], "<u4").tobytes(), 4 * capacity

    def cut(batches):
        code = coder(tokenizer)
        for b in batches:
            ids, texts = b["doc_id"], b["text"]
            for at in range(0, len(ids), BATCH_ROWS):
                rows = []
                coded = code.encode(texts[at : at + BATCH_ROWS].to_pylist())
                for doc, x in zip(ids[at : at + BATCH_ROWS].to_pylist(), coded, strict=True):
                    x += end
                    for n, s in enumerate(range(0, len(x), size)):
                        y = x[s : s + size]
                        rows.append((doc, n, s // 4, len(y) // 4, zlib.crc32(y), y) if keep_ids else (doc, n, s // 4, len(y) // 4, zlib.crc32(y)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    names, types = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    if keep_ids:
        names, types, schema = [*names, "ids"], [*types, pa.binary()], schema + ", ids binary"
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return base.mapInArrow(cut, schema)


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(patterns fixed, counts left): sets for the longest piece that dominate every other set with it.

    In turn for each length j, the longest first, with j2 the longest other piece that fits beside it:

    * nothing fits: {j};
    * j + j2 fills the capacity: {j, j2}, whose complement any other set can only match;
    * two pieces never fit beside j: {j, j2};
    * three never fit beside j, and no two that fit together exceed j2: {j, j2}.

    Passes repeat until none fixes anything.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    fixed: list[tuple[tuple[int, ...], int]] = []
    again = True
    while again and left:
        again = False
        lengths = sorted(left)
        for j in sorted(left, reverse=True):
            while left.get(j):
                n_same = left[j]
                at = bisect_right(lengths, capacity - j) - 1
                while at >= 0 and lengths[at] == j and n_same == 1:
                    at -= 1
                if at < 0:
                    fixed.append(((j,), n_same))
                    times, used = n_same, {j: n_same}
                else:
                    j2 = lengths[at]
                    if j + j2 != capacity and not _single_dominates(left, lengths, j, j2, capacity):
                        break
                    times = n_same // 2 if j2 == j else min(n_same, left[j2])
                    fixed.append(((j, j2), times))
                    used = Counter({j: times}) + Counter({j2: times})
                for x, n in used.items():
                    left[x] -= n
                    if not left[x]:
                        del left[x]
                        lengths.pop(bisect_left(lengths, x))
                again = True
    return fixed, left


def _single_dominates(left: dict[int, int], lengths: list[int], j: int, j2: int, capacity: int) -> bool:
    """Whether {j, j2} dominates all sets with j: at most two more fit, and no two of them exceed j2."""
    room = capacity - j
    smallest: list[int] = []
    for x in lengths[:4]:
        smallest += [x] * min(3, left[x] - (x == j))
        if len(smallest) >= 3:
            break
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return True
    if len(smallest) >= 3 and sum(smallest[:3]) <= room:
        return False
    low, high, best = 0, bisect_right(lengths, room) - 1, 0
    while low <= high:
        a, b = lengths[low], lengths[high]
        if a + b > room or (low == high and left[a] - (a == j) < 2):
            high -= 1
        else:
            best = max(best, a + b)
            low += 1
    return best <= j2


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with their numbers from best fit decreasing, equal sequences handled together."""
    rooms: list[int] = []
    open_: dict[int, list[list]] = {}

    def put(pattern: tuple[int, ...], room: int, n: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([pattern, n])

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            at = bisect_left(rooms, x)
            if at == len(rooms):
                pattern, room, there = (), capacity, n
            else:
                room = rooms[at]
                pattern, there = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            fill = room // x
            full = min(there, n // fill)
            if full:
                put(pattern + (x,) * fill, room - fill * x, full)
                n -= full * fill
            rest = there - full
            if n and rest:  # fewer than fill are left for the next sequence
                put(pattern + (x,) * n, room - n * x, 1)
                n, rest = 0, rest - 1
            if rest and pattern:
                put(pattern, room, rest)
    return [(pattern, n) for groups in open_.values() for pattern, n in groups]


def plan(counts: dict[int, int], capacity: int) -> pd.DataFrame:
    """Places for the pieces: for each length and run of ranks, the sequences and the offset they get."""
    fixed, left = reduce_dominated(counts, capacity)
    used: Counter[int] = Counter()
    first, rows = 0, []
    merged: Counter[tuple[int, ...]] = Counter()
    for pattern, n in fixed + best_fit(left, capacity):
        merged[pattern] += n
    for pattern, n in merged.items():
        offset = 0
        for x in pattern:
            rows.append((x, used[x], used[x] + n, first, offset))
            used[x] += n
            offset += x
        first += n
    return pd.DataFrame(rows, columns=["length", "rank_from", "rank_to", "first_sequence", "offset"])


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, piece, length up to ``capacity``, ...; a written table) with sequence_id and offset.

    Only the histogram of lengths, ``capacity`` numbers, travels to the driver; the table of places has
    a row for each part of a pattern, at most some tens of thousands for any input.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = plan(counts, capacity)
    ranked = salted_rank(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "nth")
    if places.empty:
        return pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # One row per length: its runs of ranks in order, so a piece finds its run by binary search-like filtering.
    runs = places.sort_values(["length", "rank_from"])
    table = spark.createDataFrame(runs.astype("int64")).withColumnRenamed("length", "l")
    found = ranked.join(small(table, len(runs), 48), (F.col("length") == F.col("l")) & (F.col("nth") >= F.col("rank_from")) & (F.col("nth") < F.col("rank_to")))
    return found.select(*pieces.columns, (F.col("first_sequence") + F.col("nth") - F.col("rank_from")).alias("sequence_id"), F.col("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, keep_ids: bool = False) -> DataFrame:
    """Tokenize the whole texts of ``docs`` (doc_id, text) and pack them; see :func:`tokenized`, :func:`pack`.

    A document is its ids and the separator; only documents longer than ``capacity`` are cut.

    * A null or empty text is the separator alone.
    * Repeated rows and null ids are pieces like any other. An empty table gives no rows.
    * Other columns are not read.
    """
    return pack(written(tokenized(docs, tokenizer, capacity, separator, keep_ids), "pack-pieces"), capacity)
