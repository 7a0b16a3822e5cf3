"""p2: statistics by hand, verdicts, and edge cases."""

import pytest
from pyspark.sql import functions as F

from evidex.llm import quality as Q

PROSE = "The observer watched a silver object move slowly over the ridge\nbefore it vanished behind the clouds near the old mill. A second\nwitness on the pier saw the same light at 2130 hours, and the\ncrew of the ferry signed the statement.\n"
CASES = {
    "prose": PROSE, "shout": PROSE.upper(), "noisy": PROSE.replace("o", "0", 3).replace("silver", "si1ver").replace("watched", "wat(hed"), "few items": PROSE + "\n1) film roll\n2) sketch\n", "narrow": "\n".join(PROSE.replace("\n", " ")[i : i + 28] for i in range(0, 230, 28)),
    "bullets": "* sketch\n- film roll (Hill)\n• soil sample\no debris\n", "letters": "(a) Captain Smith\n(b) Mr. Jones - absent\n(c) Dr. Hill\n", "numbers": "0104   198   29    49.3\n2026   344   31    25.4\n0205   091   51    38.2\n", "pipes": "| Station | Count |\n|---|---|\n| Hill | 3 |\n| Dale | 4 |\n",
    "fields": "DATE: June\nTIME: 5:07 a.m.\nPLACE: Hill\nCOLOR: dark\n", "semicolons": "Hill; disc; dark\nDale; ring; pale\nFord; cone; amber\n", "symbols": "x.}f!Kt<'z_k_.[-{{'[\n\\)n#/)'':-r{\"a|'<n+[ !I;~\n@}]+_||.=%c>'\n", "mojibake": "Ã¼ ï¿½aâ€™nÃ¼a Â° ï¿½a\nÃ¼nï¿½nÃ©a\nÃ©e ï¿½ ï¿½\n", "single letters": "I D Y Q u r Y C\nq V A X W Z d w\nA p Z G A K v J\n",
    "rules": "~~~~~~~~~~~~\n=============\n-------------\n", "names": "DISTRIBUTION LIST\nharbour police  x\nsignals school  xx\nobserver corps  x\n", "dots": "weather chart .......... 15\nfilm roll ....... 31\n", "header and list": PROSE.split("\n")[0] + "\n" + "TAB A: sketch, dark disc\nTAB B: statement, cone\nTAB C: film roll, ring\n",
}
GOOD = {"prose", "shout", "noisy", "few items", "narrow"}


def test_verdicts(spark):
    df = spark.createDataFrame([*CASES.items(), ("null", None), ("empty", ""), ("blank", " \n\t\n")], "name string, t string")
    got = {r["name"]: r.verdict for r in Q.judge(Q.text_statistics(df, "t")).collect()}
    assert {got.pop(x) for x in ("null", "empty", "blank")} == {"empty"}
    assert {k for k, v in got.items() if v == "prose"} == GOOD


def test_reasons_are_the_verdict(spark):
    df = spark.createDataFrame([*CASES.items(), ("empty", "")], "name string, t string")
    got = {r["name"]: r for r in Q.judge(Q.text_statistics(df, "t")).collect()}
    assert all((len(r.failed_rules) > 0) == (r.verdict not in ("prose", "empty")) for r in got.values())
    why = {k: set(r.failed_rules) for k, r in got.items()}
    assert "bullets" in why["bullets"] and "symbols" in why["symbols"] and "words_with_letters" in why["numbers"] and "stop_words" in why["names"] and "mean_word_length" in why["single letters"] and "lines_of_other_kinds" in why["header and list"]


def test_plain_lines_get_what_the_full_tests_give(spark):
    """The short cut for lines of prose changes no kind: a sign that it leaves to the full tests makes no difference here."""
    lines = [x for t in CASES.values() for x in t.split("\n") if x.strip()]
    df = spark.createDataFrame([(i, x, x + " \u00e9") for i, x in enumerate(lines)], "i int, a string, b string")
    kinds = [(r.a, r.b) for r in df.select(Q.line_kind(Q._shape(F.col("a"))).alias("a"), Q.line_kind(Q._shape(F.col("b"))).alias("b")).collect()]
    assert sum(a == "prose" for a, _ in kinds) >= 8 and all(b == "prose" for a, b in kinds if a == "prose")


def test_statistics(spark):
    df = spark.createDataFrame([("- One cat.\nTwo #hats!\n\n12", 5)], "t string, word_count int")
    r = Q.judge(Q.text_statistics(df, "t")).first()
    assert (r.char_count, r.word_count, r.line_count) == (25, 4, 3)
    assert r.alpha_ratio == pytest.approx(13 / 25, abs=1e-3) and r.mean_word_length == pytest.approx(13 / 4) and r.symbol_ratio == pytest.approx(1 / 4)
    assert r.end_punctuation_share == pytest.approx(2 / 3, abs=1e-3) and "few_words" in r.notes and "symbols" in r.failed_rules


def test_rows_pass_through(spark):
    df = spark.createDataFrame([("x", 1), ("x", 1), (None, None)], "t string, k int")
    assert Q.judge(Q.text_statistics(df, "t")).select("k").count() == 3 and Q.judge(Q.text_statistics(df.limit(0), "t")).count() == 0
