"""Typed dates: hand cases, zone transitions, edge cases, and a round trip over formats."""

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given
from hypothesis import strategies as st

from evidex.functions import timestamps as N

CASES = [
    ("2002-09-03T12:45:32Z", None, "2002-09-03T12:45Z"), ("1953-07-14 21:55:15 PDT", None, "1953-07-15T04:55Z"), ("232044Z AUG 83", None, "1983-08-23T20:44Z"), ("151620B DEC 77", None, "1977-12-15T14:20Z"),
    ("101000L SEP 17", "America/New_York", "2017-09-10T14:00Z"), ("140225ZDEC64", None, "1964-12-14T02:25Z"), ("26 September l992", None, "1992-09-26"), ("Ju1y 1, 2004", None, "2004-07-01"), ("0ctober 20, 1947", None, "1947-10-20"),
    ("Jime 16, 1981", None, "1981-06-16"), ("Septernber 3, 1950", None, "1950-09-03"), ("19 juin 20l9", None, "2019-06-19"), ("13/45/1961", None, None), ("February 30, 1957", None, None), ("0000-00-00", None, None), ("1968-125", None, "1968-05-04"),
    ("day 366 of 1999", None, None), ("day 366 of 2000", None, "2000-12-31"), ("the 19th of May 1974", None, "1974-05-19"), ("night of 25-26 May 2023", None, "2023-05-25"), ("November 19-22, 1996", None, "1996-11-19"),
    ("spring of 1980", None, "1980"), ("late august of 1990", None, "1990-08"), ("mid-Aug. 2020", None, "2020-08"), ("mid-1990s", None, "1990s"), ("1960's", None, "1960s"), ("the late seventies", None, "1970s"), ("c. 1975", None, "1975"),
    ("A.D. 1986", None, "1986"), ("1976?", None, "1976"), ("06/1975", None, "1975-06"), ("5/8/26", None, "2026-05-08"), ("5/8/27", None, "1927-05-08"), ("16 Sep 13", None, "2013-09-16"), ("15. III. 2023", None, "2023-03-15"),
    ("15.3.2013, 13.05", "Europe/Berlin", "2013-03-15T12:05Z"), ("26 July 2015, 2400 hours", "Asia/Tokyo", "2015-07-26T15:00Z"), ("at noon on 19 October 2015", "America/Phoenix", "2015-10-19T19:00Z"),
    ("5:25 p.m. on April 9, 2019", "America/Chicago", "2019-04-09T22:25Z"), ("12:05 a.m. on April 9, 2019", "UTC", "2019-04-09T00:05Z"), ("12:58 (America/Phoenix) 18 Aug 2014", None, "2014-08-18T19:58Z"), ("1046232933", None, "2003-02-26T04:15Z"),
    ("1730201723734", None, "2024-10-29T11:35Z"), ("2024-09-05 13:31", None, "2024-09-05"), ("undated", None, None), ("same night as above", None, None), ("", None, None), (None, None, None), ("20200229", None, "2020-02-29"), ("20210229", None, None),
    ("2010-08-14 25:00", "UTC", None), ("2010-08-14T10:00+05:30", None, "2010-08-14T04:30Z"), ("18 de marzo de 1947", None, "1947-03-18"), ("le 12 avril 1970", None, "1970-04-12"), ("3. Oktober 1961", None, "1961-10-03"),
]


@pytest.mark.parametrize(("text", "zone", "form"), CASES)
def test_hand_cases(text, zone, form):
    assert N.normalise_texts([text], [zone])[0] == form


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/London", "Australia/Sydney", "Asia/Kolkata", "America/Sao_Paulo"])
def test_transitions_agree_with_the_zone_database(zone):
    """Repeated times are the earlier ones, skipped times move forward by the gap: fold 0 of the standard library."""
    t, z = N.zone_table(zone), ZoneInfo(zone)
    at = datetime(1927, 1, 1)
    for k in range(0, 36_000, 7):
        local = at + timedelta(days=k, minutes=(k * 37) % 1440)
        want = local.replace(tzinfo=z).astimezone(UTC).replace(tzinfo=None)
        minute = (local - datetime(1970, 1, 1)).total_seconds() // 60
        got = datetime(1970, 1, 1) + timedelta(minutes=int(t.to_utc(N.np.array([int(minute)]))[0]))
        assert abs((got - want).total_seconds()) < 60, (local, got, want)


def test_gap_and_overlap():
    form = lambda s: N.normalise_texts([s], ["America/New_York"])[0]
    assert form("2021-03-14 02:30") == "2021-03-14T07:30Z"  # skipped: 03:30 EDT
    assert form("2021-11-07 01:30") == "2021-11-07T05:30Z"  # twice: EDT first


@given(st.dates(min_value=datetime(1928, 1, 1).date(), max_value=datetime(2025, 12, 31).date()))
def test_formats_of_one_day_agree(d):
    texts = [d.isoformat(), f"{d:%Y%m%d}", f"{d:%d.%m.%Y}", f"{d:%m/%d/%Y}", f"{d.day} {d:%B} {d.year}", f"{d:%B} {d.day}, {d.year}", f"{d:%A}, {d.day} {d:%b} {d.year}", f"{d:%Y}-{d:%j}", f"day {int(d.strftime('%j'))} of {d.year}", f"  {d:%B} {d.day} {d.year} ".upper(), f"{d:%d}-{d:%b}-{d:%Y}".upper(), f"{d.month}/{d.day}/{d:%y}"]
    assert set(N.normalise_texts(texts, [None] * len(texts))) == {d.isoformat()}


def test_each_mask_gets_one_parser():
    masks = {N.tokenise(t)[0] for t, _, f in CASES if t and f}
    assert all(N.parser_of(m) for m in masks) and len(masks) < len(CASES)


def test_column_keeps_other_columns_and_nulls(spark):
    df = spark.createDataFrame([("1962-01-02", None, 1), (None, "UTC", 2), ("1962-01-02", None, 1)], "t string, z string, normal_form_source int")
    got = sorted((r.t or "", r.normal_form or "", r.normal_form_source) for r in N.normalise_timestamps(df, "t", "z").collect())
    assert got == [("", "", 2), ("1962-01-02", "1962-01-02", 1), ("1962-01-02", "1962-01-02", 1)]
    assert N.normalise_timestamps(df.limit(0), "t", "z").count() == 0


def test_years_outside_the_transition_table_are_exact():
    from datetime import datetime, timedelta
    from zoneinfo import ZoneInfo

    import numpy as np

    from evidex.functions.timestamps import zone_table

    t = zone_table("America/New_York")
    for d in (datetime(1890, 7, 1, 12), datetime(1919, 7, 1, 12), datetime(2035, 7, 1, 12), datetime(2035, 11, 4, 1, 30), datetime(2035, 3, 11, 2, 30), datetime(2300, 1, 1)):
        m = int((d - datetime(1970, 1, 1)).total_seconds() // 60)
        want = m - round(d.replace(tzinfo=ZoneInfo("America/New_York")).utcoffset() / timedelta(minutes=1))
        assert t.to_utc(np.array([m]))[0] == want
