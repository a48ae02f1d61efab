import random
import re

from tessel.llm import license_scan as L
from tests.llm.helpers import AWKWARD, documents, with_clashes

MIT = L.TEMPLATES["mit"]
EDITED = MIT.replace("hereby ", "").replace("without limitation", "with no limits at all")
TEXTS = [
    None, "", "Under the MIT-License. under, the mit license under the mit license", "CC BY NC cc-by-nc/4.0 cc by\nnc", "xunder the mit license", "under the mit licenseé",
    "before " * 30 + MIT + " after" * 10, EDITED.upper(), MIT[: len(MIT) // 3], "Apache License, Version 2.0", "word " * 50_000 + "apache license version 2",
    L.TEMPLATES["cc-by-nc"], L.TEMPLATES["gpl"] + "\n" + L.TEMPLATES["gpl"],
]


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for p, label in L.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_awkward_and_license_texts(spark):
    rows = [(i, t, None, None, 0, "x") for i, t in enumerate(TEXTS)] + [(None, MIT, None, None, 0, "x"), (2, TEXTS[2], None, None, 0, "x")]
    got = L.scan(with_clashes(documents(spark, rows))).collect()
    assert len(got) == len(rows)
    for r in got:
        text = MIT if r.doc_id is None else TEXTS[r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in got}
    assert by[None].labels == "mit" and by[None].score == 1.0
    assert by[6].labels == "mit" and by[7].labels == "mit" and 0.8 <= by[7].score < 1
    assert by[8].labels == "" and by[8].score == 0
    assert by[11].labels == "cc-by-nc" and by[12].labels == "gpl"


def test_real_texts(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in L.scan(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert r.labels == r.base_labels and r.score == float(r.n_base > 0)


def test_long_documents_and_empty_table(spark):
    rows = [r for r in AWKWARD]
    assert L.scan(documents(spark, rows)).count() == len(rows)
    assert L.scan(documents(spark, [])).count() == 0


def in_order(want, have):
    """Longest common subsequence, by the plain table."""
    row = [0] * (len(want) + 1)
    for h in have:
        before = row
        row = [0]
        for j, w in enumerate(want):
            row.append(before[j] + 1 if w == h else max(before[j + 1], row[j]))
    return row[-1]


def best_share(label, text, room):
    want, words = L.words_of(L.TEMPLATES[label]), L.words_of(text)
    return max(in_order(want, words[i : i + room]) for i in range(len(words))) / len(want)


def edited(rng, label, how, lost):
    """A template with ``lost`` words replaced or dropped, and 3 others put in for ``how`` = "inserted"."""
    words = [w.decode() for w in L.words_of(L.TEMPLATES[label])]
    n = len(words)
    if how == "every fifth":
        at = set(range(4, n, 5))
    elif how == "block":
        start = rng.randrange(1, n - lost)
        at = set(range(start, start + lost))
    else:
        at = set(rng.sample(range(n), lost))
    out = [f"zz{i}" if i in at else w for i, w in enumerate(words) if how in ("every fifth", "replaced") or i not in at]
    for j in range(3 if how == "inserted" else 0):
        out.insert(rng.randrange(1, len(out)), f"yy{j}")
    return " ".join([f"before{i}" for i in range(9)] + out + [f"after{i}" for i in range(9)])


def test_labels_down_to_the_limit_against_a_search_of_all_spans(spark):
    rng = random.Random(6)
    made = []
    for label, template in L.TEMPLATES.items():
        n = len(L.words_of(template))
        lost = L.missing(n, 0.8)
        made.append((label, edited(rng, label, "every fifth", lost), True))
        for how in ("replaced", "dropped", "block", "inserted"):
            made += [(label, edited(rng, label, how, lost), True) for _ in range(3)]
            made.append((label, edited(rng, label, how, lost + 1), False))
    got = {r.doc_id: r for r in L.scan(documents(spark, [(i, t, None, None, 0, "x") for i, (_, t, _) in enumerate(made)])).collect()}
    for i, (label, text, whole) in enumerate(made):
        n = len(L.words_of(L.TEMPLATES[label]))
        labels, own = set(filter(None, got[i].labels.split(","))), best_share(label, text, n + 3)
        assert (own >= 0.8) == whole
        mine = label.partition("#")[0]
        for x in labels - set(got[i].base_labels.split(",")) - {mine}:
            share = max(best_share(y, text, 3 * (len(L.words_of(L.TEMPLATES[y])) + 3)) for y in L.TEMPLATES if y.partition("#")[0] == x)
            assert share >= 0.8 and (not whole or round(share, 1) >= round(own, 1))
        assert bool(labels) >= whole, (label, text)
        if labels == {mine} and not got[i].n_base:
            assert got[i].score in {best_share(y, text, 3 * (len(L.words_of(L.TEMPLATES[y])) + 3)) for y in L.TEMPLATES if y.partition("#")[0] == mine}


def test_parts_of_licenses_are_labelled(spark):
    first = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    opening = "Preamble. The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software"
    rows = [(1, f"{first} {opening}", None, None, 0, "x"), (2, first, None, None, 0, "x"), (3, "the software is free for all of this and may be used in the works", None, None, 0, "x")]
    got = {r.doc_id: r.labels for r in L.scan(documents(spark, rows)).collect()}
    assert got == {1: "bsd,gpl-3", 2: "bsd", 3: ""}


def test_joining_grams_are_left_out_as_far_as_they_are_spare():
    for text in L.TEMPLATES.values():
        words = L.words_of(text)
        for spare in (0, 1, 5, 100):
            at = L.indexed(words, 2, spare)
            assert len(words) - 1 - len(at) <= spare
            assert all(any(w.decode() not in L.JOINING for w in words[i : i + 2]) for i in set(range(len(words) - 1)) - set(at)) is (len(at) == len(words) - 1)


def test_notices_side_by_side_keep_their_labels(spark):
    names = ["cc-by", "mit", "cc-by-nc", "unlicense", "apache-2", "bsd"]
    text = " and ".join(L.TEMPLATES[x] for x in names)
    (r,) = L.scan(documents(spark, [(1, text, None, None, 0, "x")])).collect()
    assert set(names) <= set(r.labels.split(","))


def test_few_rows_go_to_few_files(spark, monkeypatch):
    """With many partitions and few documents with spans, a written table is one file (it was one for each partition with rows)."""
    made, keep = {}, L.written
    monkeypatch.setattr(L, "written", lambda df, name: made.setdefault(name, keep(df, name)))
    settings = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        found = L.scan(documents(spark, [(i, f"{i} {MIT}", None, None, 0, "x") for i in range(40)])).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(found) == 40 and all(r.labels == "mit" for r in found)
    assert {name: len(df.inputFiles()) for name, df in made.items()} == {"license-spans": 1, "license-labels": 1}
