import datetime as dt
import zoneinfo

import pytest

from skein.operators.timestamps import all_instants, header_zones, with_instant


def us(*fields, zone="UTC", micros=0, fold=0):
    t = dt.datetime(*fields, tzinfo=zoneinfo.ZoneInfo(zone), fold=fold)
    return int((t - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)).total_seconds()) * 1_000_000 + micros


CASES = [
    ("2024-03-05T02:37:16Z", None, us(2024, 3, 5, 2, 37, 16)),
    (" 2024-03-05t02:37:16z ", None, us(2024, 3, 5, 2, 37, 16)),
    ("2024-03-05T02:37:16.123456789Z", None, us(2024, 3, 5, 2, 37, 16, micros=123456)),
    ("2024-03-05T02:37:16,5+0530", None, us(2024, 3, 4, 21, 7, 16, micros=500000)),
    ("2024-03-05 02:37:16-03", None, us(2024, 3, 5, 5, 37, 16)),
    ("2024-03-05T02:37:16−03:00", None, us(2024, 3, 5, 5, 37, 16)),
    ("2024-03-05T02:37:16.238[Asia/Kolkata]", None, us(2024, 3, 5, 2, 37, 16, zone="Asia/Kolkata", micros=238000)),
    ("20240305T023716Z", None, us(2024, 3, 5, 2, 37, 16)),
    ("2024-W36-5T14:31:26Z", None, us(2024, 9, 6, 14, 31, 26)),
    ("2024-366T01:00:00Z", None, us(2024, 12, 31, 1)),
    ("2023-366T01:00:00Z", None, None),
    ("Sat, 23 Dec 2023 21:14:15 -0700", None, us(2023, 12, 24, 4, 14, 15)),
    ("Jul 17, 2023 7:04:09 PM JST", None, us(2023, 7, 17, 10, 4, 9)),
    ("Jul 17, 2023 12:04:09 AM UTC", None, us(2023, 7, 17, 0, 4, 9)),
    ("12/09/2024 01:41 PM", "America/Chicago", us(2024, 12, 9, 13, 41, zone="America/Chicago")),
    ("21.01.2025 05:17:26", "Europe/Berlin", us(2025, 1, 21, 5, 17, 26, zone="Europe/Berlin")),
    ("2024-11-03T01:30:00", "America/New_York", us(2024, 11, 3, 1, 30, zone="America/New_York")),
    ("2024-03-10T02:30:00", "America/New_York", us(2024, 3, 10, 7, 30)),
    ("2024-03-05T02:37:16", "Nowhere/Land", us(2024, 3, 5, 2, 37, 16)),
    ("1704411464", None, 1704411464000000),
    ("1735247671.227", None, 1735247671227000),
    ("1705960316220", None, 1705960316220000),
    ("1703212921011461", None, 1703212921011461),
    ("1.735247671227E9", None, 1735247671227000),
    ("0000-00-00T00:00:00", None, None),
    ("2024-13-45T99:00:00Z", None, None),
    ("2023-02-29T00:00:00Z", None, None),
    ("2024-03-05T02:37:16 XYZ", None, None),
    ("yesterday", None, None),
    ("Invalid Date", None, None),
    ("", None, None),
    ("  ", None, None),
    (None, "UTC", None),
]


def test_cascade(spark):
    df = spark.createDataFrame([(i, r, z) for i, (r, z, _) in enumerate(CASES)], "i INT, raw STRING, zone STRING")
    got = {r.i: r.utc_us for r in with_instant(df, "raw", "zone").collect()}
    wrong = [(CASES[i][0], got[i], CASES[i][2]) for i in got if got[i] != CASES[i][2]]
    assert not wrong


def test_other_columns_and_repeated_rows_stay(spark):
    df = spark.createDataFrame([("1704411464", 1, "a")] * 2, "raw STRING, day INT, text STRING")
    out = with_instant(df, "raw")
    assert out.columns == ["raw", "day", "text", "utc_us"]
    assert out.count() == 2


@pytest.fixture
def tables(spark):
    conversations = spark.createDataFrame(
        [("c1", "2024-01-01T00:00:00", None, "Asia/Tokyo"), ("c1", "2024-01-01T00:00:00", dt.datetime(2024, 1, 2), "Asia/Tokyo"), ("c2", None, None, None), (None, "1704411464", None, None)],
        "id STRING, created_at STRING, updated_at TIMESTAMP, tz STRING",
    )
    messages = spark.createDataFrame([("c1", "m1", "2024-01-01T09:00:00"), ("c1", "m1", "2024-01-01T09:00:00"), ("c9", "m2", "2024-01-01T09:00:00"), ("c2", "m3", "-")], "conversation_id STRING, id STRING, ts STRING")
    codex = spark.createDataFrame(
        [(1, "s", 0, '{"timestamp":1704411464,"payload":{"timestamp":"2024-01-01 00:00:00"}}'), (2, "s", 1, '﻿{"timestamp":"2024-01-01T00:00:00","payload":{"timezone":"Europe/Berlin"}}'), (3, "s", 2, '{"timestamp":"1704411464"'), (4, "s", 3, None), (5, "s", 4, "[1]")],
        "rec_id BIGINT, session_file STRING, line_no INT, line STRING",
    )
    return conversations, messages, codex


def test_all_tables(tables, rows):
    got = rows(all_instants(*tables))
    tokyo = us(2024, 1, 1, zone="Asia/Tokyo")
    assert got == sorted(
        [
            ("conversation", "c1", "created_at", tokyo), ("conversation", None, "created_at", 1704411464000000),
            ("message", "m1", "ts", us(2024, 1, 1)), ("message", "m2", "ts", us(2024, 1, 1, 9)),
            ("codex", "1", "timestamp", 1704411464000000), ("codex", "1", "payload.timestamp", us(2023, 12, 31, 23)), ("codex", "2", "timestamp", us(2023, 12, 31, 23)),
        ],
        key=repr,
    )


def test_empty_tables(tables):
    assert all_instants(*(t.limit(0) for t in tables)).count() == 0
    assert header_zones(tables[0].limit(0)).count() == 0
