"""p5: round trips, limits, natural ends, files against columns, and edge cases."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidex.llm import split as S


def check(text, pieces, limit, overlap):
    """pieces (from, to, body from) cover the text, keep the limit and repeat at most overlap characters."""
    at = 0
    for a, b, body in pieces:
        assert body == at and a <= body < b and b - a <= limit and body - a <= overlap
        at = b
    assert at == len(text)


@given(st.lists(st.sampled_from(["word ", "A sentence. ", "\n\n", "\n--- PAGE 2 ---\n", "x" * 37, "ß€𝄞 "]), max_size=60), st.integers(10, 60), st.integers(0, 12), st.integers(1, 3))
@settings(max_examples=150, deadline=None)
def test_ranges_agree_with_each_other(parts, limit, overlap, k):
    text = "".join(parts)
    size, h = k * 2 * limit, S._halo(limit, overlap)
    out = []
    for at in range(0, len(text), size):
        for x, y, z, _, piece in S.cut_range(text[max(at - h, 0) : at], text[at : at + size], text[at + size : at + size + h], limit, overlap):
            assert piece == text[at + y : at + z]
            out.append((at + y, at + z, at + x))
    check(text, out, limit, overlap)


def test_ends_are_natural():
    text = "First sentence here. Second one follows it. " * 20 + "\n--- PAGE 2 ---\n" + "More words. " * 40
    parts = S.cut_stretch(text, 0, len(text), 300, 40, True)
    assert all(kind in ("sentence", "page", "paragraph", "end") for *_, kind in parts)
    assert all(text[a - 1].isspace() for _, a, _, _ in parts[1:])
    assert [k for *_, k in S.cut_stretch("x" * 50, 0, 50, 20, 0, True)] == ["hard", "hard", "end"]


def test_column(spark):
    r = random.Random(3)
    text = " ".join("".join(r.choices("abcdef", k=r.randrange(1, 9))) + r.choice(["", ".", "\n\n"]) for _ in range(4000))
    data = [("a", text, 500, 50), ("b", "short", 500, 50), ("c", None, 5, 1), ("d", "", 5, 1), ("e", text[:900], None, None), ("f", text[:900], 100, -3), ("g", text[:900], 100, 5000), ("b", "short", 500, 50)]
    df = spark.createDataFrame(data, "id string, t string, lim int, ov int").selectExpr("*", "1 as piece")
    got = {}
    for x in S.split_texts(df, "id", "t", "lim", "ov", range_bytes=2000).collect():
        got.setdefault(x.id, set()).add((x.piece_no, x.piece_from, x.piece_to, x.body_from))
    whole = {i: (t, lim, ov) for i, t, lim, ov in data}
    assert set(got) == {"a", "b", "e", "f", "g"} and len(got["b"]) == len(got["e"]) == 1
    for i, (lim, ov) in {"a": (500, 50), "f": (100, 0), "g": (100, 50)}.items():
        ps = sorted(got[i])
        assert [p[0] for p in ps] == list(range(1, len(ps) + 1))
        check(whole[i][0], [p[1:] for p in ps], lim, ov)


@pytest.mark.parametrize("text", ["", "a", "word and word. " * 3000, "äöü€𝄞 wörd. " * 2500, "x" * 30_000])
def test_files_by_ranges_equal_the_text(spark, tmp_path, text):
    f = tmp_path / "f.txt"
    f.write_bytes(text.encode())
    df = S.split_files(spark, spark.createDataFrame([(str(f), len(text.encode()))] * 2, "path string, bytes long"), 300, 30, range_bytes=5000)
    ps = sorted(tuple(r) for r in df.select("piece_no", "piece_from", "piece_to", "body_from", "piece").collect())
    assert [p[0] for p in ps] == list(range(1, len(ps) + 1)) and all(text[a:b] == piece for _, a, b, _, piece in ps)
    check(text, [p[1:4] for p in ps], 300, 30)


def test_giant_text_is_cut_by_many_tasks_and_comes_back_whole(spark):
    n = 3_000_000
    df = spark.range(1).selectExpr("id", f"repeat('Wörds of a sentence. Anöther one, lönger than that. ', {n // 50}) as t", "6000 as lim", "300 as ov")
    whole = df.first().t
    got = S.split_texts(df, "id", "t", "lim", "ov").withColumn("p", F.spark_partition_id())
    rows = sorted(tuple(r) for r in got.select("piece_no", "piece_from", "piece_to", "body_from", "piece").collect())
    assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and all(whole[a:b] == piece for _, a, b, _, piece in rows)
    check(whole, [r[1:4] for r in rows], 6000, 300)
    assert len(rows) > 450


def test_column_by_ranges_equals_one_range(spark):
    r = random.Random(5)
    texts = [(i, "".join(r.choices(["ä word. ", "word ", "\n\n", "\n--- PAGE 3 ---\n", "x" * 90], k=r.randrange(1, 900))), 120, 20) for i in range(12)]
    df = spark.createDataFrame(texts, "id int, t string, lim int, ov int")
    for x in (S.split_texts(df, "id", "t", "lim", "ov", 1), S.split_texts(df, "id", "t", "lim", "ov", 1 << 20)):
        per = {}
        for row in x.collect():
            assert texts[row.id][1][row.piece_from : row.piece_to] == row.piece
            per.setdefault(row.id, []).append((row.piece_no, row.piece_from, row.piece_to, row.body_from))
        assert set(per) == set(range(12))
        for i, ps in per.items():
            check(texts[i][1], [p[1:] for p in sorted(ps)], 120, 20)
