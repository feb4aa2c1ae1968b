"""Instants of texts, against values worked out by hand, and the operator's edges."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from siftwright.operators.timestamps import after_last_semicolon, instant, normalise, source_zones

US = lambda *a: int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1_000_000)
BERLIN, CHICAGO = "Europe/Berlin", "America/Chicago"


@pytest.mark.parametrize(
    ("text", "zone", "at"),
    [
        ("Mon, 09 Jan 2023 11:52:34 -0800", None, US(2023, 1, 9, 19, 52, 34)),
        (" TUE,05 SEP 23  21:03:45 +0200 (CEST)", None, US(2023, 9, 5, 19, 3, 45)),
        ("Sat, 14 Jan 2023 12:00:00 -0000", BERLIN, US(2023, 1, 14, 12)),
        ("Sat Jan 14 07:24:21 2023", CHICAGO, US(2023, 1, 14, 13, 24, 21)),
        ("Mon Apr 24 02:49:52 CEST 2023", BERLIN, US(2023, 4, 24, 0, 49, 52)),
        ("Wed, 12 Apr 2023 18:34:50 PDT", None, US(2023, 4, 13, 1, 34, 50)),
        ("2023-01-09T04:34Z", None, US(2023, 1, 9, 4, 34)),
        ("2023-01-13 10:31:07,102+00:00", None, US(2023, 1, 13, 10, 31, 7, 102000)),
        ("2023-02-03T03:13:04[America/Los_Angeles]", None, US(2023, 2, 3, 11, 13, 4)),
        ("2023-01-20 08:08:10 Europe/Helsinki", BERLIN, US(2023, 1, 20, 6, 8, 10)),
        ("20230113T183422Z", None, US(2023, 1, 13, 18, 34, 22)),
        ("09.01.2023 15:19:33", BERLIN, US(2023, 1, 9, 14, 19, 33)),
        ("1/10/2023 12:23:29 AM", "UTC", US(2023, 1, 10, 0, 23, 29)),
        ("1/30/2024 6:39:49 PM +02:00", None, US(2024, 1, 30, 16, 39, 49)),
        ("November 14, 2023 20:13:37 +0000", None, US(2023, 11, 14, 20, 13, 37)),
        ("24. März 2023 12:38:25 +0545", None, US(2023, 3, 24, 6, 53, 25)),
        ("30 de julio de 2023 00:38:19 +0900", None, US(2023, 7, 29, 15, 38, 19)),
        ("1673275863", None, 1673275863_000000),
        ("1673442418797", None, 1673442418797_000),
        ("1673297530948720", None, 1673297530948720),
        ("133179819675267250", None, 133179819675267250 // 10 - 11644473600000000),
        ("2023-03-26T02:30:00", BERLIN, None),  # never there
        ("2023-10-29T02:30:00", BERLIN, None),  # twice there
        ("2023-10-29T02:30:00+02:00", BERLIN, US(2023, 10, 29, 0, 30)),
        ("2024-02-30 11:00:00", "UTC", None),
        ("Thu, 32 Foo 2024 25:61:00 +0000", "UTC", None),
        ("2023-01-09T10:00:00", None, None),
        ("2023-01-09T10:00:00 Nowhere/City", "UTC", None),
        ("13:00:00 PM", "UTC", None),
        ("9999999999", None, None),
        ("yesterday 14:00", "UTC", None),
        ("", "UTC", None),
        (None, "UTC", None),
        ("x" * 100_000, "UTC", None),
    ],
)
def test_instant(text, zone, at):
    assert instant(text, zone) == at


def test_first_text_that_states_an_instant_decides(spark):
    relays = spark.createDataFrame([("A.Test.", BERLIN), ("b.test", "UTC"), ("b.test", CHICAGO), (None, "UTC"), ("c.test", None), ("d.test", "No/Zone")], "host string, tz string")
    zones = source_zones(relays, "host", "tz")
    rows = [
        (1, "a.test", "2023-01-09 10:00:00", None, "x"), (2, "a.test", "soon", "by b; id 1;\r\n\t2023-01-09T10:00:00Z", "x"), (3, "b.test", "2023-01-09 10:00:00", "no stamp", "x"),
        (4, None, None, None, None), (5, "d.test", "2023-01-09 10:00:00", ";2023-01-09 10:00:00", "x"), (1, "a.test", "2023-01-09 10:00:00", None, "x"),
    ]
    df = spark.createDataFrame(rows, "hop_id long, by_host string, ts string, raw string, source string")
    got = normalise(df, "hop_id", "by_host", [F.col("ts"), after_last_semicolon(F.col("raw"))], zones).collect()
    assert sorted((r.hop_id, r.utc_us) for r in got) == [(1, US(2023, 1, 9, 9)), (1, US(2023, 1, 9, 9)), (2, US(2023, 1, 9, 10))]
    assert normalise(df.limit(0), "hop_id", "by_host", [F.col("ts")], zones).count() == 0


def test_years_are_a_parameter():
    from siftwright.operators.timestamps import instant, year_begins

    assert year_begins(2023) == 1_672_531_200_000_000 and year_begins(2026) == 1_767_225_600_000_000
    assert instant("1000000000", None) is None and instant("1000000000", None, (2001, 2001)) == 1_000_000_000_000_000
    assert instant("1672531200", None) == 1_672_531_200_000_000 and instant("1672531200", None, (2000, 2010)) is None
