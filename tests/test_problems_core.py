"""The general problem operators on small tables: nulls, ties, repeats, empty tables, extra columns with clashing names."""

import random
import zoneinfo
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bitemporal
from tidemark.operators.bitemporal import as_known
from tidemark.operators.history import attribute_history, size_history
from tidemark.operators.outliers import implausible_lists, spikes
from tidemark.operators.rolling import daily_filings, trailing_totals
from tidemark.sources.stamps import to_instants

U = timezone.utc
T0 = datetime(2020, 1, 1, tzinfo=U)


def known(spark, events, facts, attrs=("a", "b")):
    e = spark.createDataFrame(events, "id long, who string, t timestamp, cell string, head string, seq int, value string")
    f = spark.createDataFrame(facts, "who string, attr string, at timestamp, seq long, x double, rec_to string, cell string, t string")
    return {(r.id, r.attribute): (r.seq, r.value) for r in as_known(e, "who", "t", f, "who", "attr", "at", "seq", "x", attrs, "id").collect()}


def ev(i, who, t):
    return (i, who, t, "c", "h", 1, "v")


def fact(who, attr, at, seq, x):
    return (who, attr, at, seq, x, "r", "c", "t")


def test_as_known_is_strict_masks_and_breaks_ties(spark):
    d = timedelta(days=1)
    facts = [fact("e", "a", T0, 1, 1.0), fact("e", "a", T0 + d, 2, 2.0), fact("e", "a", T0 + d, 3, 3.0), fact("e", "a", T0 + 100 * d, 4, None), fact("e", "a", T0 + 200 * d, 5, float("nan")), fact(None, "a", T0, 6, 9.0), fact("e", "a", None, 7, 9.0), fact("e", None, T0, 8, 9.0)]
    events = [ev(1, "e", T0), ev(2, "e", T0 + d), ev(3, "e", T0 + d + timedelta(microseconds=1)), ev(4, "e", T0 + 90 * d), ev(5, "e", T0 + 101 * d), ev(6, "e", T0 + 300 * d), ev(7, None, T0 + d), ev(8, "e", None), ev(9, "never", T0)]
    assert known(spark, events, facts) == {(2, "a"): (1, 1.0), (3, "a"): (3, 3.0), (4, "a"): (3, 3.0), (5, "a"): (4, None), (6, "a"): (5, None)}
    assert known(spark, events, []) == {} and known(spark, [], facts) == {}


def test_as_known_against_brute_force(spark):
    rnd = random.Random(4)
    at = lambda: T0 + timedelta(hours=rnd.randrange(0, 3000))
    facts = [fact(rnd.choice("pqr"), rnd.choice("ab"), at(), i, rnd.choice([1.0, 2.0, None])) for i in range(400)]
    events = [ev(i, rnd.choice("pqr"), at()) for i in range(200)]
    want = {}
    for e in events:
        for a in "ab":
            best = max(((f[2], f[3], f[4]) for f in facts if f[0] == e[1] and f[1] == a and f[2] < e[2]), default=None, key=lambda x: x[:2])
            if best:
                want[e[0], a] = best[1:]
    assert known(spark, events, facts) == want


@pytest.mark.parametrize("dense", [1, 64])
def test_as_known_on_both_axes(spark, monkeypatch, dense):
    monkeypatch.setattr(bitemporal, "DENSE", dense)
    rnd = random.Random(9)
    day = lambda: rnd.choice([None, date(2020, 1, 1) + timedelta(days=rnd.randrange(60))])
    at = lambda: T0 + timedelta(hours=rnd.randrange(0, 900))
    facts = [(rnd.choice("pq"), "a", at(), i, float(i % 5) if i % 7 else None, day(), day()) for i in range(300)]
    events = [(i, rnd.choice("pqz"), at(), day()) for i in range(150)]
    f = spark.createDataFrame(facts, "who string, attr string, at timestamp, seq long, x double, start date, stop date")
    e = spark.createDataFrame(events + events[:5], "id long, who string, t timestamp, day date")
    got = as_known(e, "who", "t", f, "who", "attr", "at", "seq", "x", ["a"], "id", valid_at="day", valid_from="start", valid_to="stop").collect()
    want = []
    for i, who, t, d in events + events[:5]:
        known = [x for x in facts if x[0] == who and x[2] < t and d and (x[5] is None or x[5] <= d) and (x[6] is None or d < x[6])]
        want += [(i, *max(known, key=lambda x: (x[2], x[3]))[3:5])] if known else []
    order = lambda rows: sorted(rows, key=repr)
    assert order((r.id, r.seq, r.value) for r in got) == order(want) and len(want) > 50


def test_valid_spans_cover_their_days_once(spark):
    rows = [(date(2020, 1, 1), date(2020, 1, 1)), (date(2020, 1, 1), date(2020, 3, 17)), (date(1999, 12, 31), date(2031, 7, 2)), (date(2020, 5, 2), date(2020, 5, 1))]
    df = spark.createDataFrame(rows, "a date, b date")
    for r in df.select("a", "b", bitemporal.valid_spans(F.unix_date("a"), F.unix_date("b")).alias("s")).collect():
        days = [d for x in r.s for d in range(x.place << x.level, (x.place + 1) << x.level)]
        first = (r.a - date(1970, 1, 1)).days - bitemporal.FIRST_DAY
        assert sorted(days) == list(range(first, first + max(0, (r.b - r.a).days))) and len(r.s) <= 2 * bitemporal.TOP
    assert df.select(bitemporal.valid_spans(F.lit(None).cast("long"), F.lit(None).cast("long")).alias("s")).first().s == [(bitemporal.TOP, 0)]


def totals(spark, rows, **kw):
    df = spark.createDataFrame(rows, "k string, d date, v double, n7 string, __v string")
    return {(r.k, r.d): (r.n2, r.n4, r.avg2) for r in trailing_totals(df, ["k"], "d", "v", (2, 4), **kw).collect()}


def test_trailing_totals(spark):
    d = date(2021, 2, 27)
    rows = [("x", d, 1.0, "", ""), ("x", d, 2.0, "", ""), ("x", d + timedelta(10), 5.0, "", ""), (None, d, 1.0, "", ""), ("x", None, 9.0, "", ""), ("y", d, None, "", ""), ("y", d, float("nan"), "", "")]
    got = totals(spark, rows)
    assert got["x", d] == (3.0, 3.0, 1.5) and got["x", d + timedelta(2)] == (0.0, 3.0, 0.0) and ("x", d + timedelta(5)) not in got
    assert got[None, d] == (1.0, 1.0, 0.5) and got["y", d] == (0.0, 0.0, 0.0)
    full = totals(spark, rows, zeros=True)
    assert full["x", d + timedelta(5)] == (0.0, 0.0, 0.0) and len([k for k in full if k[0] == "x"]) == 14
    assert {k: v for k, v in full.items() if k in got} == got and totals(spark, []) == {}


def test_filings_count_once_by_local_day(spark):
    t = datetime(2020, 7, 1, 3, 30, tzinfo=U)  # still the last of June in New York
    rows = [(1, "A", "CIK0000000007", t, "c"), (2, "A", " 7 ", t, "c"), (3, "A", "0000000007", t, "c2"), (4, None, "7", t, "c"), (5, None, "7", t, "c"), (6, "B", "x", t, "c"), (7, "C", None, t, "c"), (8, "D", "7", None, "c"), (9, "E", "7", t, None)]
    e = spark.createDataFrame(rows, "event_id long, accession string, entity string, published_at timestamp, category string")
    assert {(r.cik, r.category, str(r.event_day), r.filings) for r in daily_filings(e).collect()} == {(7, "c", "2020-06-30", 3), (7, "c2", "2020-06-30", 1)}


def test_spikes_levels_and_ends():
    m = list(range(40))
    flat = [0.01 * (i % 3) for i in m]

    def put(**at):
        x = list(flat)
        for k, v in at.items():
            x[int(k[1:])] += v
        return spikes(x, m, 0.02)

    assert put() == [] and put(_10=2.0) == [10] and put(_10=-2.0, _11=-2.1, _12=-2.0) == [10, 11, 12]
    assert put(_10=2.0, _20=-1.0) == [10, 20] and put(_39=2.0) == [] and put(_0=2.0) == []
    assert spikes(flat[:20] + [v + 1 for v in flat[20:]], m, 0.02) == []
    step = flat[:20] + [v + 1 for v in flat[20:]]
    step[22] += 3
    assert spikes(step, m, 0.02) == [22]
    assert spikes([1.0, 2.0], [0, 1], 0.1) == []


def test_implausible_lists(spark):
    rows, i = [], 0
    for s in range(4):
        for k in range(30):
            i += 1
            px = 100 * (1.01 if (k + s) % 2 else 1.0)
            if s == 0 and k == 12:
                px = 1000.0
            if s == 1 and 5 <= k <= 11:
                px = 77.0
            if s == 2:
                px = [px, None, float("nan"), 0.0, -1.0, float("inf")][k - 20] if 20 <= k <= 25 else px
            if s == 3 and k >= 15:
                px = px / 4  # a split
            rows.append((i, s, date(2010, 1, 31) + timedelta(30 * k), "src" if s else None, px, 4e6 if s == 3 and k >= 15 else 1e6, "clash", "clash"))
    rows += [(1000, 0, rows[12][2], None, 1000.0, 1e6, "", ""), (1001, None, date(2010, 1, 1), "src", -5.0, 1e6, "", ""), (1002, 1, None, "src", 5.0, None, "", "")]
    df = spark.createDataFrame(rows, "list_id long, cik long, d date, src string, px double, sh double, spike string, stuck string")
    got = {r.list_id: r.reason for r in implausible_lists(df, "cik", "d", "list_id", "src", ["px", "sh"], "px").collect()}
    assert got == {13: "spike", 1000: "spike", **{i: "stuck" for i in range(37, 43)}, 84: "impossible", 85: "impossible", 86: "impossible", 1001: "impossible"}
    assert implausible_lists(df.limit(0), "cik", "d", "list_id", "src", ["px", "sh"], "px").collect() == []


def stamps(spark, texts, tz="America/New_York"):
    s = spark.createDataFrame([(i, 1, t, "x", "y") for i, t in enumerate(texts)], "id long, calendar_id int, raw string, parsed string, utc_micros string")
    c = spark.createDataFrame([(1, tz), (None, tz)], "calendar_id int, tz string")
    return [r.utc_micros for r in to_instants(s, "raw", c).orderBy("id").collect()]


def us(*a):
    return int(datetime(*a, tzinfo=U).timestamp() * 1_000_000)


def test_stamps(spark):
    same = ["2021-03-01T12:00:00Z", "2021-03-01 07:00", "03/01/2021 7:00:00 AM", "Mon, 01 Mar 2021 12:00:00 +0000", "Mar 01, 2021 07:00 AM EST", "01-MAR-2021 07:00:00", "20210301070000", "1614600000", "1614600000000", "\t2021-03-01T13:00:00+01:00\n", "2021-03-01T06:00:00[America/Chicago]", "2021-03-01 17:30:00 +0530", "2021-03-01 17:45:00+0545", "2021-03-01t12:00:00,000z", "20210301T120000Z"]
    assert stamps(spark, same) == [us(2021, 3, 1, 12)] * len(same)
    bad = [None, "", "  ", "soon", "2021-02-30", "2021-13-01 10:00", "2021-01-01T25:00", "31/31/2021 10:00", "0000-00-00 00:00:00", "20211345120000", "1:2|3", "x" * 100_000, "2021-01-01 10:00 XYZ", "2021-01-01T10:00[No/Where]", "13/1/2021 13:00:00 PM"]
    assert stamps(spark, bad) == [None] * len(bad)
    assert stamps(spark, ["2021-11-07 01:30:00", "2021-03-14 02:30:00", "2021-03-13", "2021-01-01T00:00:00.123456789Z"]) == [us(2021, 11, 7, 6, 30), us(2021, 3, 14, 7), us(2021, 3, 14, 5), us(2021, 1, 1) + 123456]
    assert stamps(spark, ["2021-04-04 01:45:00", "2021-10-03 02:10:00"], "Australia/Lord_Howe") == [us(2021, 4, 3, 15, 15), us(2021, 10, 2, 15, 30)]
    assert stamps(spark, []) == []


@pytest.mark.parametrize("tz", ["America/New_York", "Asia/Manila", "Europe/Lisbon", "Africa/Casablanca", "Australia/Sydney"])
def test_stamps_of_any_year(spark, tz):
    zone = zoneinfo.ZoneInfo(tz)
    days = [(y, m, d) for y in (1, 1500, 1839, 1845, 1883, 1899, 1901, 2050, 2101, 2128, 2129, 2160, 2399, 2400, 2401, 9998) for m, d in ((1, 1), (3, 12), (7, 4), (11, 3), (12, 31))]
    local = [datetime(*d, 12, 34, 56) for d in days]
    want = [round((x.replace(tzinfo=zone) - datetime(1970, 1, 1, tzinfo=U)).total_seconds()) * 1_000_000 for x in local]
    assert stamps(spark, [f"{x.year:04d}-{x.month:02d}-{x.day:02d} 12:34:56" for x in local], tz) == want


def test_stamps_through_a_year_of_clock_changes(spark):
    zone = zoneinfo.ZoneInfo("Europe/Berlin")
    texts, want = [], []
    for h in range(0, 24 * 366, 7):
        w = datetime(2020, 1, 1) + timedelta(hours=h, minutes=17)
        both = {w.replace(tzinfo=zone, fold=f).astimezone(U) for f in (0, 1)}
        real = [b for b in both if b.astimezone(zone).replace(tzinfo=None) == w]
        if real:
            texts.append(w.isoformat(" "))
            want.append(int(max(real).timestamp() * 1_000_000))
    assert stamps(spark, texts, "Europe/Berlin") == want


def test_history(spark):
    d = timedelta(days=300)
    rows = [(1, T0, 1, " ab ", 1.0), (2, T0 + d, 1, "AB", 1.0), (3, T0 + 2 * d, 1, "ab", 2.0), (4, T0 + 2 * d, 1, "AB", 1.0), (5, T0 + 3 * d, 1, None, 1.0), (6, T0 + 4 * d, 1, None, 1.0), (7, T0 + 5 * d, 1, "ab", 1.0), (8, T0 + 6 * d, 1, "ab", float("nan")), (9, T0 + 7 * d, 1, "ab", float("nan")), (10, T0 + 8 * d, 1, "ab", None), (11, None, 1, "z", 1.0), (12, T0, None, "z", 1.0), (13, T0, 2, "q", 0.0), (14, T0 + d, 2, "q", -0.0)]
    s = spark.createDataFrame([(*r, "c") for r in rows], "snap_id long, _available timestamp, cik long, code string, mcap double, version string")
    got = sorted((r.cik, r.version, r.opened_by, r.closed_by) for r in size_history(s).collect())
    assert got == [(1, 1, 1, 5), (1, 2, 5, 7), (1, 3, 7, 8), (1, 4, 8, 10), (1, 5, 10, None), (2, 1, 13, None)]
    assert size_history(s.limit(0)).collect() == []
    tiny = attribute_history(s, "cik", "_available", "snap_id", {"mcap": F.col("mcap")}, days=1)
    assert sorted((r.cik, r.opened_by, r.closed_by) for r in tiny.collect() if r.cik == 2) == [(2, 13, None)]


def test_history_against_brute_force_across_cells(spark):
    rnd = random.Random(1)
    rows = [(i, T0 + timedelta(days=rnd.randrange(2000)), rnd.randrange(3), "x", float(rnd.randrange(2))) for i in range(300)]
    last = {}
    for r in rows:
        last[r[2], r[1]] = r if (r[2], r[1]) not in last or r[0] > last[r[2], r[1]][0] else last[r[2], r[1]]
    want = []
    for c in range(3):
        opened = []
        prev = object()
        for (_, _), r in sorted((k, v) for k, v in last.items() if k[0] == c):
            if r[4] != prev:
                opened.append(r[0])
            prev = r[4]
        want += [(c, a, b) for a, b in zip(opened, [*opened[1:], None])]
    s = spark.createDataFrame(rows, "snap_id long, _available timestamp, cik long, code string, mcap double")
    assert sorted((r.cik, r.opened_by, r.closed_by or -1) for r in size_history(s).collect()) == sorted((a, b, c or -1) for a, b, c in want)
