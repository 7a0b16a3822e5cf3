"""p10: counts and scores against brute force, made spam and prose, and edge cases."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidex.llm import spam as S

PRODUCTS = ["green visor", "meteor ring", "drone detector", "space mug", "signal jammer", "glow stickers", "crystal pendant", "saucer lamp"]
NOUNS = "observer ridge harbour light witness statement film tower crew ferry pilot station evening north cloud copper azimuth sheet".split()
VERBS = "watched signed copied crossed reported measured followed described told filed".split()


def corpus(seed=1):
    r = random.Random(seed)
    prose = lambda n: " ".join(f"The {r.choice(NOUNS)} {r.choice(VERBS)} the {r.choice(NOUNS)} near the {r.choice(NOUNS)} in {r.randrange(1950, 1999)}." for _ in range(n))
    odd = lambda w: w.translate(str.maketrans("oi", "01")) if r.random() < 0.5 else w[:2] + "​" + w[2:]
    docs = [(prose(12), False) for _ in range(150)]
    for _ in range(12):
        docs += [
            (", ".join(r.choice(PRODUCTS) for _ in range(30)), True), ("\n".join(f"https://a{r.randrange(99)}.example/{r.choice(PRODUCTS).replace(' ', '-')}/{r.randrange(999)}" for _ in range(12)), True),
            (" ".join("#" + "".join(w.title() for w in r.choice(PRODUCTS).split()) for _ in range(20)), True), (" ".join(odd(r.choice(PRODUCTS)) for _ in range(30)), True),
            (" ".join(f'<li><a href="//x{r.randrange(99)}.example/1">{r.choice(PRODUCTS)}</a></li>' for _ in range(15)), True), ("\n".join(f"SKU {r.randrange(99999):05d} {r.choice(PRODUCTS).upper()} XL $5.99" for _ in range(15)), True),
            (prose(10) + " See https://a.example/x and the green visor.", False), ("Finding aid\n" + "\n".join(f"Box {r.randrange(40)}, folder {r.randrange(30)}: {r.choice(NOUNS)} {r.choice(NOUNS)}, {r.choice(NOUNS)}" for _ in range(14)), False),
            (prose(20) + " " + " ".join(r.choice(PRODUCTS) for _ in range(8)), False),
        ]
    return docs


def test_made_spam(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(docs)], "doc_id long, t string").withColumn("words", F.lit("clash"))
    got = {r.doc_id for r in S.flag_pages(S.page_scores(df, "doc_id", "t")).filter("reason is not null").collect()}
    want = {i for i, (_, bad) in enumerate(docs) if bad}
    assert len(got & want) / len(want) >= 0.97 and len(got - want) <= 1


def test_information_against_brute_force(spark):
    docs = [t for t, _ in corpus(2)[:80]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, t string")
    got = {r.doc_id: r.mean_information for r in S.page_scores(df, "doc_id", "t").collect()}
    ids = S._Ids()
    words = {i: S.word_ids(t, ids)[0] for i, t in enumerate(docs)}
    uni = Counter(w for ws in words.values() for w in ws if w)
    pairs = {i: [(a, b) for a, b in zip(ws, ws[1:], strict=False) if a and b] for i, ws in words.items()}
    both, total = Counter(p for ps in pairs.values() for p in ps), sum(uni.values())
    pairs_all = sum(both.values())
    for i, ps in pairs.items():
        want = sum(math.log2(both[p] / pairs_all * total / uni[p[0]] * total / uni[p[1]]) for p in ps) / len(ps)
        assert got[i] == pytest.approx(want, abs=0.01)


def test_information_is_exact_whatever_is_sent(spark):
    r = random.Random(8)
    df = spark.createDataFrame([(i, " ".join(f"w{'abcdefgh'[min(int(r.expovariate(0.6)), 7)]}{'xyz'[r.randrange(3)]}" for _ in range(30)) + " buy now" * (4 * (i == 5))) for i in range(40)], "doc_id long, t string")
    want, got = ({x.doc_id: tuple(x)[1:] for x in S.page_scores(df, "doc_id", "t", least).collect()} for least in (1e-6, 0.02))
    assert want.keys() == got.keys() and all(got[i] == pytest.approx(want[i], abs=1e-5) for i in want)
    assert want[5][2] > 0.1


def test_words():
    ids = S._Ids()
    ws = lambda t: S.word_ids(t, ids)
    assert ws("dr0ne detect0r")[0] == ws("drone de​tector")[0] == ws("Drone Detector")[0]
    assert ws("#GreenVisor")[0] == ws("green visor")[0] and ws("#GreenVisor")[1] == [6, 2] and ws("the 19th of 1950")[0].count(S.NUMBER) == 2
    assert ws("[green visor](http://a.example/p?id=1) now")[1][:2] == [5, 1] and ws("[green visor](http://a.example/p?id=1) now")[1][-1] == 0


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (None, "two words"), (4, "12 34"), (4, "12 34")], "doc_id long, t string")
    got = {(r.doc_id, r.words, r.spam_share, r.reason) for r in S.flag_pages(S.page_scores(df, "doc_id", "t")).collect()}
    assert got == {(2, 0, 0.0, None), (3, 1, 0.0, None), (None, 2, 0.0, None), (4, 0, 0.0, None)}
    assert S.page_scores(df.limit(0), "doc_id", "t").count() == 0


def test_verdicts_hold_in_a_corpus_ten_times_as_large(spark):
    docs = [d for seed in range(3, 13) for d in corpus(seed)]
    first = len(corpus(3))
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(docs)], "doc_id long, t string")
    flagged = lambda x: {r.doc_id for r in S.flag_pages(S.page_scores(x, "doc_id", "t")).filter("reason is not null").collect()}
    small, large = flagged(df.filter(f"doc_id < {first}")), flagged(df)
    want = {i for i, (_, bad) in enumerate(docs) if bad}
    assert len(small ^ {i for i in large if i < first}) <= 0.02 * first
    assert len(large & want) / len(want) >= 0.97 and len(large - want) <= 0.01 * len(docs)


def test_repeated_pair_is_found_among_many_others(spark):
    r = random.Random(6)
    spam_ = (99_999, " ".join(f"cheap pills {x}" for x in ("now", "here", "today", "fast", "sale", "shop", "best", "deal")))
    wide = spark.createDataFrame([(i, " ".join("".join(r.choices("abcdefgh", k=4)) for _ in range(60))) for i in range(1200)] + [spam_], "doc_id long, t string")
    assert {x.doc_id: x.repeated_share for x in S.page_scores(wide, "doc_id", "t").collect()}[99_999] > 0.5


def test_links_count_where_they_repeat(spark):
    prose = " ".join(f"The {r} was filed near the ridge by the crew." for r in NOUNS)
    few = prose + " See https://a.example/x/y/z and https://b.example/q."
    list_ = "\n".join(f"{i}. https://a{i}.example/{NOUNS[i]}/{i}" for i in range(9))
    df = spark.createDataFrame([(1, prose), (2, few), (3, list_)], "doc_id long, t string")
    got = {r.doc_id: (r.link_share, r.reason) for r in S.flag_pages(S.page_scores(df, "doc_id", "t")).collect()}
    assert got[1] == got[2] == (0.0, None) and got[3][0] > 0.9 and got[3][1] == "links"


def test_word_salad_is_flagged(spark):
    r = random.Random(8)
    common = "the of and to in that was it for on with as had they this from".split()
    prose = [" ".join(f"the {r.choice(NOUNS)} {r.choice(VERBS)} that of the {r.choice(NOUNS)} and it was for this" for _ in range(8)) for _ in range(300)]
    salad = " ".join(r.choice(["this this", "and and", "was was", "for for", "that that", "it it"][k % 6].split()) for k in range(120))
    df = spark.createDataFrame([*enumerate(prose), (999, salad)], "doc_id long, t string")
    got = {x.doc_id: x.mean_information for x in S.page_scores(df, "doc_id", "t").collect()}
    assert got[999] < min(v for k, v in got.items() if k != 999) - 2
