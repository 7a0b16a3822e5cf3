"""p7: furniture, cut and misread words on a made file with known noise, reflow, and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from evidex.llm import repair as R

SENTENCES = ["The observer watched a silver object move slowly over the northern ridge.", "A second witness on the pier saw the same light at 2130 hours.", "The crew of the ferry signed the statement before the fog lifted.", "No known aircraft was near the harbour that evening, and the radar station was told.", "The straw-yellow light turned north and vanished behind a cloud bank."]


def archive(seed, files=6, pages=8):
    """Pages with running headers and numbers, words cut at line ends and misread words; and the lines of each kind."""
    r = random.Random(seed)
    out, truth = [], set()
    for f in range(files):
        for p in range(1, pages + 1):
            words = " ".join(f"{r.choice(SENTENCES)} File {''.join(r.choices('bdgkpvxz', k=8))} was kept." for _ in range(9)).split()
            words = ["".join(r.choices("bdgkpvxz", k=8)) for _ in range(4)] + words[r.randrange(6) :]
            lines, line, marks = [], "", []
            for w in words:
                if len(line) + len(w) > 52:
                    k = set()
                    if r.random() < 0.3 and w.isalpha() and len(w) > 6:
                        lines.append(f"{line} {w[:4]}-")
                        k.add("hyphen")
                        line = w[4:]
                    else:
                        lines.append(line)
                        line = w
                    marks.append(k)
                else:
                    line = f"{line} {w}".strip()
            lines.append(line)
            marks.append(set())
            for i, x in enumerate(lines):
                ws = x.split()
                j = r.randrange(len(ws))
                if r.random() < 0.12 and ws[j].isalpha() and len(ws[j]) > 5 and 0 < j < len(ws) - 1:
                    bad = ws[j].replace("e", "c", 1) if r.random() < 0.5 else ws[j].replace("i", "1", 1)
                    if bad != ws[j]:
                        ws[j] = bad
                        marks[i].add("misread")
                        lines[i] = " ".join(ws)
            text = [f"Harbour Station, File {f}71", "", *lines, "", f"- {p} -"]
            out.append((f"f{f}", p, "\n".join(text) + "\n"))
            truth |= {(f"f{f}", p, 1, "furniture"), (f"f{f}", p, len(text), "furniture")}
            truth |= {(f"f{f}", p, i + 3, k) for i, ks in enumerate(marks) for k in ks}
    return out, truth


def test_kinds_of_lines(spark):
    data, truth = archive(1)
    df = spark.createDataFrame(data, "f string, p int, t string").withColumn("line_no", F.lit("clash"))
    got = {tuple(r) for r in R.line_kinds(df.unionByName(df.limit(3)), "f", "p", "t").collect()}
    for kind in ("furniture", "hyphen", "misread"):
        a, b = {x for x in got if x[3] == kind}, {x for x in truth if x[3] == kind}
        assert len(a & b) / len(b) >= 0.9 and len(a & b) / len(a) >= 0.9, kind


def test_repaired_pages(spark):
    data, _ = archive(2)
    df = spark.createDataFrame(data, "f string, p int, t string")
    got = R.repair_pages(df, "f", "p", "t").collect()
    text = " ".join(r.repaired for r in got)
    assert "Harbour Station" not in text and not any(line.strip().startswith("- ") for line in text.split("\n"))
    words = {w for s in SENTENCES for w in s.split()} | {"File", "was", "kept."}
    assert sum(w in words or len(w) == 8 for w in text.split()) / len(text.split()) >= 0.97


def test_edge_cases(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, ""), ("a", 3, " \n \n"), (None, 1, "x"), ("b", None, "y")], "f string, p int, t string")
    assert R.line_kinds(df, "f", "p", "t").count() == 0 and R.repair_pages(df, "f", "p", "t").count() == 0 and R.line_kinds(df.limit(0), "f", "p", "t").count() == 0


@pytest.mark.parametrize(("word", "meant"), [("altbough", "although"), ("mem0randum", "memorandum"), ("shovving", "showing"), ("acceleratecl", "accelerated"), ("triarigle", "triangle"), ("coppér", "copper"), ("rem@rked", "remarked"), ("ci9ar", "cigar"), ("wat(hed", "watched"), ("steeplv", "steeply"), ("bhnking", "blinking")])
def test_variants(word, meant):
    assert R.may_be(word, meant) and R.strokes(meant) in R.lookups(word)


def test_every_confusion_is_looked_up():
    for read, xs in R.CONFUSIONS.items():
        for x in xs.split():
            if x.isalpha():
                assert R.may_be(f"pre{read}post", f"pre{x}post") and R.strokes(f"pre{x}post") in R.lookups(f"pre{read}post"), (read, x)
    for c, xs in R.SIGNS.items():
        for x in xs:
            assert R.may_be(f"pre{c}post", f"pre{x}post") and R.strokes(f"pre{x}post") in R.lookups(f"pre{c}post"), (c, x)
    assert not R.may_be("same", "same") and not R.may_be("ridge", "bridge") and not R.may_be("", "a")


def test_context_decides_between_two_prints(spark):
    """'bam' may be 'barn' or 'ham': the words around it tell, and without vectors the more frequent one would always win."""
    r = random.Random(3)
    farm, food = "hay roof cattle meadow fence field tractor horse".split(), "bread cheese eggs butter supper plate mustard kitchen".split()
    line = lambda w, ws: " ".join([*r.sample(ws, 3), w, *r.sample(ws, 3)])
    data = [("f", p, "\n".join([*(line("barn", farm) for _ in range(9)), *(line("ham", food) for _ in range(6))])) for p in range(60)]
    data += [("g", 1, line("bam", farm)), ("g", 2, line("bam", food))]
    df = spark.createDataFrame(data, "f string, p int, t string")
    got = {x.p: x.repaired for x in R.repair_pages(df, "f", "p", "t").filter("f = 'g'").collect()}
    assert "barn" in got[1] and "ham" in got[2]


def test_vectors_do_not_depend_on_partitions(spark):
    r = random.Random(4)
    pairs = spark.createDataFrame([(r.randrange(30), r.randrange(30), r.randrange(1, 9)) for _ in range(500)], "w int, c int, n long")
    words = [(f"w{i}", 50 + i) for i in range(30)]
    a, b = (R.skip_grams(x, words) for x in (pairs.repartition(1), pairs.repartition(7)))
    assert (a.v == b.v).all() and (a.u == b.u).all() and abs(a.v).max() > 0.05
    assert R.skip_grams(pairs.limit(0), words).v.shape == (30, 32) and R.skip_grams(pairs.limit(0), []).ids == {}


def test_every_pair_of_neighbours_is_trained(spark):
    """A pair that is one of millions would hardly ever be drawn."""
    r = random.Random(6)
    rows = [(i, j, r.randrange(90_000, 110_000)) for i in range(29) for j in range(29) if (i < 14) == (j < 14)]
    rows += [(29, 3, 1), (3, 29, 1)]
    got = R.skip_grams(spark.createDataFrame(rows, "w int, c int, n long"), [(f"w{i}", 1000) for i in range(30)])
    assert abs(got.v[29]).max() > 0.05 and got.fit("w29", [3]) > max(got.fit("w29", [c]) for c in range(14, 29))


def test_reflow_and_pages(spark):
    assert R.reflow("HEAD\n\nA cut wo-\nrd here.\nNext\n\n1) item\n2) item\n   New paragraph\n", {1}, {3}, {4: {"here": "there"}}) == "A cut word there. Next\n\n1) item\n\n2) item\n\nNew paragraph"
    df = spark.createDataFrame([("a", "--- PAGE 1 ---\nx\n--- PAGE 5 ---\ny"), ("b", "plain\ntext"), ("c", None), (None, "z")], "k string, t string")
    assert sorted((r.k, r.page_number, r.text) for r in R.pages_of(df, "k", "t").collect()) == [("a", 1, "x"), ("a", 5, "y"), ("b", 1, "plain\ntext")]
