import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessel.llm import packing
from tests.llm.helpers import AWKWARD, documents, with_clashes

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_ids_are_the_tokenizers(spark):
    code, whole = packing.Coder(PATH), Tokenizer.from_file(PATH)
    texts = [r[1] or "" for r in AWKWARD] + ["ΑΣ σΣ", "é x́", "a\x1cb\x85c\xa0d", "I'll 'RE it''s", "²³¼ ª º µ", "ÿŸ İ ß", "<|startoftext|>a", "<|EndOfText|>", "x" * 3000, "!!!,,., a,b"]
    for text, ids in zip(texts, code.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_ids_of_real_texts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    code, whole = packing.Coder(PATH), Tokenizer.from_file(PATH)
    texts = [r.text or "" for r in rows]
    for ids, want in zip(code.encode(texts), whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids


def test_pieces_cover_the_documents(spark):
    rows = packing.pack_documents(with_clashes(documents(spark)), PATH, 256, keep_ids=True).collect()
    whole = Tokenizer.from_file(PATH)
    want = Counter()
    for r in AWKWARD:
        ids = whole.encode(r[1] or "", add_special_tokens=False).ids + [0]
        for n, s in enumerate(range(0, len(ids), 256)):
            want[r[0], n, s, len(ids[s : s + 256]), zlib.crc32(np.asarray(ids[s : s + 256], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_packing(rows, 256)
    assert packing.pack_documents(documents(spark, []), PATH).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_few_sequences(spark, seed):
    rng = random.Random(seed)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(5.5, 1.2)))) for _ in range(20000))
    patterns = packing.plan(counts, 2048)
    total = int((patterns["rank_to"] - patterns["rank_from"]).sum())
    assert total == sum(counts.values())
    sequences = max((patterns["first_sequence"] + patterns["rank_to"] - patterns["rank_from"]))
    assert sequences <= 1.01 * -(-sum(x * n for x, n in counts.items()) // 2048) + 1


def optimum(items, capacity):
    items = sorted(items, reverse=True)
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        tried = set()
        for k, r in enumerate(rooms):
            if r >= items[i] and r not in tried:
                tried.add(r)
                go(i + 1, rooms[:k] + [r - items[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_the_optimum(items):
    fixed, left = packing.reduce_dominated(dict(Counter(items)), 20)
    rest = [x for x, n in left.items() for _ in range(n)]
    assert Counter(x for p, n in fixed for x in p * n) + Counter(rest) == Counter(items)
    assert all(sum(p) <= 20 for p, _ in fixed)
    assert sum(n for _, n in fixed) + (optimum(rest, 20) if rest else 0) == optimum(items, 20)
    assert combinations


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_holds_every_piece(items):
    patterns = packing.best_fit(dict(Counter(items)), 50)
    assert all(sum(p) <= 50 for p, _ in patterns)
    assert Counter(x for p, n in patterns for x in p * n) == Counter(items)
