"""p8: suffix array and index against brute force, leaks against an alignment without index, and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidex.llm import leak as L


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_search(seed):
    r = np.random.default_rng(seed)
    t = r.integers(1, 5, 400)
    t[r.choice(400, 12, replace=False)] = 0
    t[-1] = 0
    t[100:140] = t[10:50]
    ends = np.flatnonzero(t == 0)
    key = [[(0, int(np.searchsorted(ends, j))) if t[j] == 0 else (1, int(t[j])) for j in range(i, 400)] for i in range(400)]
    sa = L.suffix_array(t)
    assert sa.tolist() == sorted(range(400), key=key.__getitem__)
    fm = L.FMIndex(t, sample=5)
    patterns = np.array([t[i : i + 3] for i in range(0, 390, 7) if 0 not in t[i : i + 3]] + [[9, 1, 1]])
    lo, hi = fm.search(patterns)
    for p, a, b in zip(patterns, lo, hi, strict=True):
        assert sorted(fm.locate(np.arange(a, b)).tolist()) == [i for i in range(398) if t[i : i + 3].tolist() == p.tolist()]


WORDS = "light moved over ridge north silent red disc hovered left slowly witness saw twice copper tint negative scratched azimuth read station told copy sheet film roll tower crew ferry signed statement fog lifted harbour".split()


def passages(r, n):
    return [(i, " ".join(r.choices(WORDS, k=40)) + ".") for i in range(n)]


def test_leaks_against_alignment(spark):
    r = random.Random(5)
    items = passages(r, 12)
    notice = "this notice stands in many places and says nothing about any of the objects named in the file"
    items = [(i, f"{notice}. {p}" if i < 5 else p) for i, p in items]
    docs = []
    for d in range(60):
        i, p = r.choice(items)
        w = p.split()
        part = w[len(w) // 3 :] if d % 3 else w[:6]
        part = [("c0pper" if x == "copper" else x).upper() if d % 2 else x for x in part]
        if d % 4 == 1 and len(part) > 20:
            part[10] = "changed"
        docs.append((d, "<p>" + " ".join(r.choices(WORDS, k=20)) + "</p> " + " ".join(part) + f" {notice} " + " ".join(r.choices(WORDS, k=15)), 1))
    df = spark.createDataFrame(docs, "doc_id long, t string, share int")
    got = {(x.doc_id, x.item_id) for x in L.find_leaks(df, "doc_id", "t", items, block_words=500).collect()}
    known = L.Passages(items)
    v = L.Vocabulary(known.folded)
    want = set()
    for d, t, _ in docs:
        a = np.array([v[w] for w in L.text_words(t)])
        for i, p in known.ids.items():
            if L.matched_words(a, p, known.counts[i])[0] >= len(p) / 3:
                want.add((d, i))
    assert got == want and len(want) > 20
    assert not known.counts[0].all() and known.counts[7].all()


def test_edge_cases(spark):
    items = [(1, "one two three four five six seven eight"), (2, None), (3, "short"), (4, "")]
    df = spark.createDataFrame([(1, None), (2, ""), (None, "one two three four five six seven eight"), (3, "x ONE two, three\nfour five six sev-\nen eight"), (3, "x ONE two, three\nfour five six sev-\nen eight")], "doc_id long, t string").withColumn("item_id", F.lit("clash"))
    assert {(r.doc_id, r.item_id) for r in L.find_leaks(df, "doc_id", "t", items).collect()} == {(3, 1)}
    assert L.find_leaks(df, "doc_id", "t", []).count() == 0 and L.find_leaks(df.limit(0), "doc_id", "t", items).count() == 0


def test_spans_are_merged():
    a = np.arange(2, 30)
    words, spans = L.matched_words(np.r_[a[:10], [99], a[11:20], a[5:15]], a, np.ones(28, bool))
    assert spans == [(0, 30)] and words == 20


def test_changed_leaks_of_items_that_share_phrases(spark):
    """Pairs of items share most phrases, and one word in three is changed after the first phrase: few phrases of a leak belong to one item and stand whole."""
    r = random.Random(8)
    items = []
    for i in range(0, 20, 2):
        a = r.choices(WORDS, k=60)
        b = [w if k % 11 else r.choice(WORDS) for k, w in enumerate(a)]
        items += [(i, " ".join(a)), (i + 1, " ".join(b))]
    notice = "this notice stands in many places and says nothing about any of the objects named in the file"
    items += [(i, f"{notice} {' '.join(r.choices(WORDS, k=30))}") for i in range(20, 26)]
    docs = []
    for d in range(80):
        i = r.randrange(26)
        w = items[i][1].split()
        w = w if i >= 20 else w[(at := r.randrange(30)) : at + 30]
        from_ = 18 if i >= 20 else 4
        docs.append((d, " ".join(r.choices(WORDS, k=9)) + " outside words here " + " ".join("changed" if k >= from_ and (k - from_) % (3 + d % 3) == 0 else x for k, x in enumerate(w))))
    df = spark.createDataFrame(docs, "doc_id long, t string")
    got = {(x.doc_id, x.item_id) for x in L.find_leaks(df, "doc_id", "t", items, block_words=700).collect()}
    known = L.Passages(items)
    v = L.Vocabulary(known.folded)
    ids = {d: np.array([v[w] for w in L.text_words(t)]) for d, t in docs}
    want = {(d, i) for d, a in ids.items() for i, p in known.ids.items() if L.matched_words(a, p, known.counts[i])[0] >= len(p) / 3}
    assert got == want and len(want) > 80
    assert not known.counts[20].all() and any(i >= 20 for _, i in want)
