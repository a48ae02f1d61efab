import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from tessel.llm import suffix_dedup as D
from tests.llm.helpers import AWKWARD, documents, with_clashes


def brute(docs, length):
    """(id, text) in document order -> (id, n_bytes, n_removed, n_spans, sha256)."""
    seen, out = set(), []
    for i, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            x = data[s : s + length]
            if x in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(x)
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for s in range(len(gone)) if gone[s] and (s == 0 or not gone[s - 1]))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got(df):
    return sorted(tuple(r)[:5] for r in df.collect())


def texts(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(10, 80))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [rng.choice([" ".join(word() for _ in range(rng.randint(0, 60))), rng.choice(passages)]) for _ in range(rng.randint(0, 5))]
        out.append(" ".join(parts))
        if rng.random() < 0.2:
            x = out[rng.randrange(len(out))]
            out.append(x[: rng.randint(0, len(x))] + "Z" + x[rng.randint(0, len(x)) :])
    return out + ["ab " * 300, "x" * 1000, "x" * 500, "ab " * 200 + "c", "", None, "é" * 99, out[0], out[1] + out[1]]


@pytest.mark.parametrize("seed,crowd,parts", [(1, 4096, 7), (2, 1, 3), (3, 2, 5)])
def test_against_brute_force(spark, seed, crowd, parts):
    docs = list(enumerate(texts(seed)))
    random.Random(seed).shuffle(docs)
    df = with_clashes(documents(spark, [(i, t, "en", "s", 1, "x") for i, t in docs])).repartition(5)
    for length in (40, 100, 300, 400) if crowd == 2 else (100, 40):
        assert got(D.remove_repeats(df, length=length, crowd=crowd, parts=parts)) == brute(sorted(docs), length)


@pytest.mark.parametrize("weak", ["h", "r", "hr"])
def test_bytes_decide_where_hashes_clash(spark, monkeypatch, weak):
    """With hashes of few values, runs that differ meet and must stay."""
    docs = list(enumerate(texts(6, 60)))
    whole = D.runs_of

    def clashing(at, data, length):
        h, r, s, n = whole(at, data, length)
        return (h % np.uint64(3) if "h" in weak else h), (r % np.uint64(2) if "r" in weak else r), s, n

    monkeypatch.setattr(D, "runs_of", clashing)
    monkeypatch.setattr(D, "ORDERED", 100)
    monkeypatch.setattr(D, "REDUCE", 2000)
    runs = D.runs_of(np.array([0, 600]), np.frombuffer(("ab" * 150 + "cd" * 150).encode(), np.uint8), 100)
    assert len(np.unique(runs[0])) <= 3 or weak == "r"
    df = documents(spark, [(i, t, "en", "s", 1, "x") for i, t in docs]).repartition(4)
    assert got(D.remove_repeats(df, length=60, parts=3)) == brute(docs, 60)


def test_lengths_that_do_not_fit_are_refused(spark):
    for length in (1, 1 << 16):
        with pytest.raises(ValueError, match="length"):
            D.remove_repeats(documents(spark), length=length)


def test_real_texts(spark, sf_small):
    df = spark.read.parquet(f"{sf_small}/documents.parquet")
    docs = sorted((r.doc_id, r.text) for r in df.collect())
    assert got(D.remove_repeats(df)) == brute(docs, 100)


def test_long_texts_are_cut_with_overlap(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 512)
    data = [(i, t) for i, t in enumerate(texts(9, 40))] + [(999, " ".join(t or "" for t in texts(9, 40)))]
    import pyarrow as pa

    runs = []
    for row, offset, at, part in D.pieces(pa.array([t or "" for _, t in data]), 100):
        h, r, s, n = D.runs_of(at, part, 100)
        doc = np.searchsorted(at, s, "right") - 1
        runs += [(row + d, int(x - at[d] + offset + j)) for d, x, m in zip(doc, s, n, strict=True) for j in range(m)]
    want = [(i, s) for i, (_, t) in enumerate(data) for s in range(len((t or "").encode()) - 99)]
    assert sorted(runs) == want


def test_awkward_rows(spark):
    rows = got(D.remove_repeats(documents(spark, [(r[0] if r[0] is not None else 99, *r[1:]) for r in AWKWARD]), length=30))
    assert len(rows) == len(AWKWARD)
    result = D.remove_repeats(with_clashes(documents(spark)), length=30).collect()
    assert len(result) == len(AWKWARD)
    by = {}
    for r in result:
        by.setdefault(r.doc_id, set()).add(tuple(r))
    assert {r[2] for r in by[1]} == {0} and {r[2] for r in by[2]} == {43} and len(by[2]) == 1
    assert max(r[2] for r in by[None]) == 43 and {r[2] for r in by[4]} == {0}
    assert D.remove_repeats(documents(spark, [])).count() == 0


def test_longest_previous_factor():
    rng = np.random.default_rng(3)
    for _ in range(30):
        text = rng.integers(0, 3, 60).astype(np.uint8).tobytes()
        order = sorted(range(len(text)), key=lambda i: text[i:])
        shared = lambda a, b: next((k for k in range(len(text)) if a + k >= len(text) or b + k >= len(text) or text[a + k] != text[b + k]), 0)
        lcp = np.array([0] + [shared(a, b) for a, b in zip(order, order[1:], strict=False)])
        lpf = D.longest_previous(np.array(order), lcp)
        for place, i in enumerate(order):
            assert lpf[place] == max((shared(i, j) for j in range(i)), default=0)


def test_gathering_takes_little_memory():
    """Slices of 16 MB are gathered with places of a part of them at a time."""
    rng = np.random.default_rng(1)
    data, sizes = rng.integers(0, 256, 1 << 20).astype(np.uint8), rng.integers(0, 268, 120_000)
    starts = rng.integers(0, len(data) - 268, len(sizes))
    tracemalloc.start()
    found = D.gather(data, starts, sizes)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6 * len(found)
    assert found.tobytes() == b"".join(data[s : s + n].tobytes() for s, n in zip(starts, sizes, strict=True))
    assert len(D.gather(data, starts[:0], sizes[:0])) == 0


def test_packed_runs_are_small():
    """Packed runs come back, in 20 bytes each where the hashes alone are 12."""
    rng = np.random.default_rng(2)
    runs = np.zeros(50_000, D.RUN)
    runs["h"], runs["r"] = rng.integers(0, 1 << 63, len(runs)), rng.integers(0, 1 << 32, len(runs))
    runs["doc"], runs["s"], runs["n"] = rng.integers(0, 2000, len(runs)) + (1 << 40), rng.integers(0, 5000, len(runs)), rng.integers(1, 70, len(runs))
    blobs = list(D.packed(D.RUNS, runs, D.spread(runs["h"], 8)))
    assert sum(len(b) for _, _, b in blobs) < 20 * len(runs)
    back = D.unpacked([b for _, _, b in blobs], D.RUN)
    assert sorted(back.tolist()) == sorted(runs.tolist())


def test_texts_are_dealt_packed_and_never_joined(spark, monkeypatch):
    monkeypatch.setattr(D, "DEALT", 3000)
    rng = random.Random(5)
    words = ["w" + str(i) for i in range(50)]
    docs = {i: " ".join(rng.choices(words, k=rng.choice([0, 5, 400]))) + "é" for i in range(60)}
    df = spark.createDataFrame(list(docs.items()), "doc long, text string").repartition(2)
    back, packed = {}, 0
    for r in D.dealt(df, 7).collect():
        ids, sizes, data = D.dealt_texts(bytes(r["data"]))
        assert (D.spread(ids, 7) == r["part"]).all() and r["kind"] == D.TEXTS
        at = np.concatenate(([0], np.cumsum(sizes)))
        back |= {int(i): data[s:e].tobytes().decode() for i, s, e in zip(ids, at[:-1], at[1:], strict=True)}
        packed += len(r["data"])
    assert back == docs and packed < 0.7 * sum(len(t.encode()) for t in docs.values())
    out = D.remove_repeats(df.withColumnRenamed("doc", "doc_id"), length=60, parts=3)  # unique ids
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
