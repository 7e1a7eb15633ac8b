"""Schedules against the stated cases and a minute-by-minute count."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import schedule as S


def at(text):
    return datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp()


def text(t):
    return datetime.fromtimestamp(t, UTC).strftime("%m-%d %H:%M")


def test_stated_fires():
    c = S.Cron.parse("*/15 9-17 * * mon-fri")
    assert [text(t) for t in S.iter_fires(c, at("2026-03-11 08:59:30"), 3)] == ["03-11 09:00", "03-11 09:15", "03-11 09:30"]
    assert [text(t) for t in S.iter_fires(S.Cron.parse("0 0 1 * mon"), at("2026-03-28 00:00"), 3)] == ["03-30 00:00", "04-01 00:00", "04-06 00:00"]
    assert S.Cron.parse("0 0 30 2 *").next_after(0) is None
    assert S.Cron.parse("0 0 29 2 *").next_after(at("2026-01-01 00:00")) == at("2028-02-29 00:00")
    assert S.Cron.parse("0 9 * * mon-fri").next_after(at("2026-03-13 09:00")) == at("2026-03-16 09:00")
    assert c.summary()["minute"] == "0,15,30,45" and c.summary()["day"] == "*"
    assert S.Cron.parse("5/20 * ? * 7").fields["minute"] == [5, 25, 45] and S.Cron.parse("5/1 * * * 7").fields["minute"] == [5] and S.Cron.parse("* * * * 7").fields["weekday"] == [0]


@pytest.mark.parametrize("bad", ["", "* * * *", "60 * * * *", "* * 0 * *", "5-1 * * * *", "*/0 * * * *", "a * * * *", "* * * foo *", "1,,2 * * * *", "@never", "1/ * * * *", None])
def test_bad_cron(bad):
    with pytest.raises(S.ScheduleError):
        S.Cron.parse(bad)


@pytest.mark.parametrize("source", ["*/7 3,5 * * *", "30 12 13 * fri", "0 0 1 1 *", "15 */6 * feb-apr sun", "0 22 */2 * *"])
def test_cron_by_the_minute(spark, source):
    c, start = S.Cron.parse(source), datetime(2026, 1, 30, 11, 17, tzinfo=UTC)
    minutes = [start + timedelta(minutes=i) for i in range(1, 70 * 1440)]

    def fires(t):
        f = c.fields
        day, week = t.day in f["day"], t.isoweekday() % 7 in f["weekday"]
        fits = (day or week) if not c.free & {"day", "weekday"} else day and week
        return t.minute in f["minute"] and t.hour in f["hour"] and t.month in f["month"] and fits

    want = [t.timestamp() for t in minutes if fires(t)]
    got = [r.at for r in c.fires(spark, start.timestamp(), minutes[-1].timestamp()).orderBy("at").collect()]
    assert got == want and S.iter_fires(c, start.timestamp(), len(want[:50])) == want[:50]
    points = [start.timestamp() + random.Random(1).random() * 60 * 86400 for _ in range(30)]
    rows = spark.createDataFrame([(p,) for p in points], "p double").select("p", c.next_fire(F.col("p")).alias("n"), c.matches_at(F.col("p")).alias("m")).collect()
    assert all(r.n == c.next_after(r.p) and r.m == c.matches(r.p) for r in rows)
    if want:
        assert c.previous_before(want[-1]) == (want[-2] if len(want) > 1 else c.previous_before(want[-1])) and c.previous_before(want[-1] + 1) == want[-1]


def test_intervals(spark):
    t = S.Interval(60.0, anchor=30.0, limit=4)
    assert [t.next_after(x) for x in (0, 30, 89.9, 90, 209, 210)] == [30.0, 90.0, 90.0, 150.0, 210.0, None]
    assert [r.at for r in t.fires(spark, 0, 1e6).orderBy("at").collect()] == [30.0, 90.0, 150.0, 210.0]
    assert t.occurrence(90.0) == 1 and t.occurrence(91.0) is None and t.occurrence(270.0) is None
    assert S.Once(5.0).next_after(4) == 5.0 and S.Once(5.0).next_after(5) is None and S.Never().next_after(0) is None
    assert isinstance(S.make_trigger("@daily"), S.Cron) and S.make_trigger("every 30s").every == 30 and S.make_trigger(90).every == 90 and isinstance(S.make_trigger(None), S.Never)
    for bad in (True, "often", 0, object()):
        with pytest.raises(S.ScheduleError):
            S.make_trigger(bad)


def test_calendars(spark):
    c = S.Calendar.of(holidays=["2026-03-13"], windows=["09:00-17:00"])
    assert c.align(at("2026-03-13 10:00")) == at("2026-03-16 09:00") and c.align(at("2026-03-12 10:00:30")) == at("2026-03-12 10:00:30") and c.align(at("2026-03-12 08:59:30")) == at("2026-03-12 09:00")
    assert c.business_days_between(at("2026-03-09 00:00"), at("2026-03-16 00:00")) == 4 and c.next_business_day(at("2026-03-12 12:00")) == at("2026-03-16 00:00")
    night = S.Calendar.of(weekend=["sun"], windows=["22:00-02:00", "12:30-13:00"])
    points = [at("2026-03-01 00:00") + random.Random(n).random() * 30 * 86400 for n in range(120)]
    for cal in (c, night, S.Calendar(), S.Calendar.of()):
        rows = spark.createDataFrame([(p,) for p in points], "p double")
        p = F.col("p")
        for r in rows.select("p", cal.open_at(p).alias("o"), cal.aligned(p).alias("a"), cal.next_business_at(p).alias("n"), cal.business_days(p, p + 864000).alias("d")).collect():
            assert (r.o, r.a, r.n, r.d) == (cal.is_open(r.p), cal.align(r.p), cal.next_business_day(r.p), cal.business_days_between(r.p, r.p + 864000))
            t = r.p if cal.is_open(r.p) else next(m for m in (int(r.p // 60) * 60.0 + 60 * k for k in range(10 * 1440)) if cal.is_open(m) and m >= int(r.p // 60) * 60)
            assert r.a == t
    merged = S.merge_calendars("m", [c, S.Calendar.of(weekend=[], windows=["08:00-12:00", "16:30-18:00"])])
    assert merged.windows == ((540, 720), (990, 1020)) and merged.weekend == {5, 6}
    assert S.merge_calendars("n", [S.Calendar.of(windows=["01:00-02:00"]), S.Calendar.of(windows=["03:00-04:00"])]).windows == ()
    for bad in ("9-17", "25:00-26:00", "09:60-10:00", "09:00-09:00"):
        with pytest.raises(S.ScheduleError):
            S.parse_window(bad)
    with pytest.raises(S.ScheduleError):
        S.Calendar.of(weekend=range(7)).align(0.0)


def test_timetables(spark):
    start, end = at("2026-03-12 00:00"), at("2026-03-18 00:00")
    hours = S.Calendar.of(windows=["09:00-17:00"])
    for policy in ("skip", "defer"):
        table = S.Timetable([S.Entry("q", "w", S.make_trigger("0 */6 * * *"), hours, on_closed=policy), S.Entry("n", "v", S.make_trigger("@daily")), S.Entry("off", "v", S.make_trigger("@hourly"), enabled=False)])
        want, heads = [], {0: start, 1: start}
        for n in heads:
            t = table.entries[n].next_after(start)
            while t is not None and t <= end:
                want.append((t, n))
                t = table.entries[n].next_after(t)
        got = [(r.at, r.pos) for r in table.between(spark, start, end).collect()]
        assert got == sorted(want) and [(t, table.entries.index(e)) for t, e in table.upcoming(start, 5)] == sorted(want)[:5]
        assert table.next_fire(start)[0] == sorted(want)[0][0]
    table.enable("off")
    table.remove("n")
    assert [e.name for e in table.entries] == ["q", "off"] and len(table.for_workflow("v")) == 1
    with pytest.raises(S.ScheduleError):
        table.add(S.Entry("q", "w", S.Never()))
