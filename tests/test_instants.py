from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from sedimenta.operators.instants import to_utc, zone_changes


def run(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d string, z string").selectExpr("*", "'x' as spans", "1 as year")
    out = to_utc(df, "d", "z").collect()
    return [r.utc_us for r in sorted(out, key=lambda r: r.i)]


def us(*a):
    return int((datetime(*a, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


CASES = [
    ("2008-04-30T14:32:35+05:45", None, us(2008, 4, 30, 8, 47, 35)),
    ("Mon, 17 Feb 2014 19:44:08 +0545", "UTC", us(2014, 2, 17, 13, 59, 8)),
    (" Thu,  22 Apr 2010 18:29 -0000 ", None, us(2010, 4, 22, 18, 29)),
    ("Sun, 12 Feb 2012 10:25:45 +0100 (CET)", None, us(2012, 2, 12, 9, 25, 45)),
    ("11 Sep 09 11:43:51 JST", None, us(2009, 9, 11, 2, 43, 51)),
    ("Wed Dec 16 18:27:55 PST 2009", None, us(2009, 12, 17, 2, 27, 55)),
    ("Mon Sep  7 14:38:09 2009 +1000", None, us(2009, 9, 7, 4, 38, 9)),
    ("Apr 25, 2017 12:32:34 AM", "UTC", us(2017, 4, 25, 0, 32, 34)),
    ("Sep 30, 2008 1:16:05 PM PDT", None, us(2008, 9, 30, 20, 16, 5)),
    ("24.06.2015 07:01", "Europe/Berlin", us(2015, 6, 24, 5, 1)),
    ("20080615T214452Z", None, us(2008, 6, 15, 21, 44, 52)),
    ("2014年10月22日 15:35:47 +05:30", None, us(2014, 10, 22, 10, 5, 47)),
    ("28 décembre 2009 12:51:47 +01:00", None, us(2009, 12, 28, 11, 51, 47)),
    ("12. März 2008 12:54:17 +0530", None, us(2008, 3, 12, 7, 24, 17)),
    ("2015-08-14T11:27:39,364501+01:00", None, us(2015, 8, 14, 10, 27, 39, 364501)),
    ("2012-12-14 03:22:10+09", None, us(2012, 12, 13, 18, 22, 10)),
    ("2011-03-30T11:16:42[America/New_York]", "UTC", us(2011, 3, 30, 15, 16, 42)),
    ("2008-05-07 03:24:48 Asia/Kolkata", None, us(2008, 5, 6, 21, 54, 48)),
    ("1199915299", None, 1199915299 * 10**6),
    ("1201587188535", "Asia/Tokyo", 1201587188535 * 10**3),
    ("1203930722694779", None, 1203930722694779),
    ("1526515743.022", None, 1526515743022000),
    ("2011-11-06 01:40:48", "America/Los_Angeles", us(2011, 11, 6, 8, 40, 48)),  # twice: the first
    ("2010-03-28 01:25:52", "Europe/London", us(2010, 3, 28, 1, 25, 52)),  # skipped: the offset before
    ("2018-04-10 21:25:30", " asia/tokyo ", us(2018, 4, 10, 12, 25, 30)),
    *[(x, "UTC", None) for x in ("0000-00-00 00:00:00", "2008-02-30T10:11:12Z", "Tue, 31 Jun 2008 09:05:00 +0200", "2011-13-05T01:02:03+00:00", "2018-09-26", "n/a", "(no date)", "", None, "Thu, ?? ??? 2008", "2008-01-01T25:00:00Z", "Apr 25, 2017 13:32:34 AM")],
    ("2018-04-10 21:25:30", None, None),
    ("2018-04-10 21:25:30", "Mars/Base", None),
]


def test_formats(spark):
    got = run(spark, [(d, z) for d, z, _ in CASES])
    assert [(d, g) for (d, _, _), g in zip(CASES, got, strict=True)] == [(d, w) for d, _, w in CASES]


@pytest.mark.parametrize("zone", ["America/New_York", "Australia/Sydney", "Asia/Kathmandu", "Europe/Helsinki"])
def test_against_brute_force(spark, zone):
    z = ZoneInfo(zone)
    times = [datetime(2009, 1, 1) + timedelta(hours=7 * k, minutes=13) for k in range(1300)]
    times += [datetime(2009, m, d, h, 30) for m in (3, 4, 10, 11) for d in range(1, 31) for h in (1, 2, 3)]
    got = run(spark, [(t.isoformat(" "), zone) for t in times])

    def want(t):
        a = t.replace(tzinfo=z, fold=0)
        return int((a - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))

    # fold 0 is the first of two, and the offset before a gap
    assert got == [want(t) for t in times]


def test_zone_changes_are_exact():
    spans = zone_changes("Europe/Berlin")
    assert (int(datetime(2015, 3, 29, 1, tzinfo=timezone.utc).timestamp()) in {a for a, _, _ in spans}) and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_empty(spark):
    assert to_utc(spark.createDataFrame([], "d string, z string"), "d", "z").count() == 0
