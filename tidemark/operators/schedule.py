"""Schedules as generators of fires: cron, interval, once, calendars and timetables.

A schedule is parsed on the driver; its fires over a span come as a DataFrame. Days are generated first and filtered,
then crossed with the times of day, so that a rare schedule costs a row a day and not a row a minute. next_fire(),
is_open(), align() and the like are also column expressions, for any number of instants. All times are UTC epoch
seconds; the session's time zone must be UTC.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from datetime import UTC, date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.faults import CronSyntax, ScheduleError
from tidemark.functions.scalars import coerce_duration, format_duration, iso_text

DAY = 86400
#: Days that a search covers, steps that an alignment or a row of skipped fires may take.
SEARCH_DAYS, ALIGN_DAYS, SKIPS = 4 * 366, 400, 1000
MONTHS = dict(zip("jan feb mar apr may jun jul aug sep oct nov dec".split(), range(1, 13)))
WEEKDAYS = dict(zip("sun mon tue wed thu fri sat".split(), range(7)))
FIELDS = {"minute": (0, 59), "hour": (0, 23), "day": (1, 31), "month": (1, 12), "weekday": (0, 7)}
MACROS = {
    "@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *",
    "@hourly": "0 * * * *",
}


def _utc(at: float) -> datetime:
    return datetime.fromtimestamp(float(at), UTC)


def _day_of(at: Column) -> Column:
    """Days since 1970."""
    return F.floor(at / DAY).cast("int")


def _date_of(day: Column) -> Column:
    return F.date_from_unix_date(day)


def _minute_of(at: Column) -> Column:
    return F.floor((at - F.floor(at / DAY) * DAY) / 60).cast("int")


# Cron ----------------------------------------------------------------------------------------------------------------


def _number(name: str, text: str) -> int:
    low, high = FIELDS[name]
    text = text.strip().lower()
    value = {"month": MONTHS, "weekday": WEEKDAYS}.get(name, {}).get(text)
    if value is None and text.isdigit():
        value = int(text)
    if value is None or not low <= value <= high:
        raise CronSyntax(f"{name}: {text!r} is not between {low} and {high}")
    return value


def _values(name: str, text: str) -> list[int]:
    """All numbers of one field: lists of *, n, a-b, each with an optional /step; n/step with a step above 1 runs to the end."""
    found: set[int] = set()
    for part in text.split(","):
        m = re.fullmatch(r"(\*|[^/]+?)(?:/(\d+))?", part)
        if m is None or m[2] and int(m[2]) < 1:
            raise CronSyntax(f"{name}: cannot read {part!r}")
        step, (low, high) = int(m[2] or 1), FIELDS[name]
        if m[1] != "*":
            ends = m[1].split("-", 1) if "-" in m[1][1:] else [m[1]]
            low = _number(name, ends[0])
            high = _number(name, ends[1]) if len(ends) == 2 else high if step > 1 else low
            if low > high:
                raise CronSyntax(f"{name}: {part!r} runs backwards")
        found.update(range(low, high + 1, step))
    return sorted({v % 7 for v in found} if name == "weekday" else found)


@dataclass(frozen=True)
class Cron:
    """Five fields. A day matches if both day fields do; if neither is "*", one is enough."""

    source: str
    fields: dict[str, list[int]]
    free: frozenset[str]

    @classmethod
    def parse(cls, text: str) -> Cron:
        source = text.strip() if isinstance(text, str) else ""
        parts = MACROS.get(source.lower(), source).split()
        if len(parts) != len(FIELDS) or parts[0].startswith("@"):
            raise CronSyntax(f"not a cron expression: {text!r}")
        parts = ["*" if p == "?" and n in ("day", "weekday") else p for n, p in zip(FIELDS, parts)]
        return cls(source, {n: _values(n, p) for n, p in zip(FIELDS, parts)}, frozenset(n for n, p in zip(FIELDS, parts) if p == "*"))

    @property
    def minutes(self) -> list[int]:
        """Minutes of a day at which it fires."""
        return [h * 60 + m for h in self.fields["hour"] for m in self.fields["minute"]]

    def on_day(self, day: date) -> bool:
        by_day, by_weekday = day.day in self.fields["day"], day.isoweekday() % 7 in self.fields["weekday"]
        if "day" in self.free or "weekday" in self.free:
            fits = (by_day or "day" in self.free) and (by_weekday or "weekday" in self.free)
        else:
            fits = by_day or by_weekday
        return fits and day.month in self.fields["month"]

    def on_date(self, day: Column) -> Column:
        """on_day() of a date column."""
        by_day, by_weekday = F.dayofmonth(day).isin(*self.fields["day"]), (F.dayofweek(day) - 1).isin(*self.fields["weekday"])
        if "day" in self.free or "weekday" in self.free:
            fits = (F.lit(True) if "day" in self.free else by_day) & (F.lit(True) if "weekday" in self.free else by_weekday)
        else:
            fits = by_day | by_weekday
        return fits & F.month(day).isin(*self.fields["month"])

    def matches(self, at: float) -> bool:
        moment = _utc(at)
        return moment.hour * 60 + moment.minute in self.minutes and self.on_day(moment.date())

    def matches_at(self, at: Column) -> Column:
        return _minute_of(at).isin(*self.minutes) & self.on_date(_date_of(_day_of(at)))

    def next_after(self, at: float) -> float | None:
        """The first fire strictly after an instant, or None if the search's days hold none."""
        first = _utc(at).replace(second=0, microsecond=0) + timedelta(minutes=1)
        return self._search(first, 1, first + timedelta(days=SEARCH_DAYS))

    def previous_before(self, at: float) -> float | None:
        """The last fire strictly before an instant."""
        last = _utc(at).replace(second=0, microsecond=0)
        last -= timedelta(minutes=1) if last >= _utc(at) else timedelta(0)
        return self._search(last, -1, last - timedelta(days=SEARCH_DAYS))

    def _search(self, moment: datetime, way: int, horizon: datetime) -> float | None:
        times, day = self.minutes, moment.date()
        own = moment.hour * 60 + moment.minute
        for n in range(SEARCH_DAYS + 2):
            if self.on_day(day):
                left = times if n else times[bisect_left(times, own) :] if way > 0 else times[: bisect_right(times, own)]
                if left:
                    found = datetime(day.year, day.month, day.day, tzinfo=UTC) + timedelta(minutes=left[0] if way > 0 else left[-1])
                    return found.timestamp() if (found < horizon) == (way > 0) and found != horizon else None
            day += timedelta(days=way)
        return None

    @property
    def reach(self) -> int:
        """Days within which a day matches, if any does: a week by weekday, two months by day of the month, else the whole search."""
        if "month" not in self.free:
            return SEARCH_DAYS
        return 7 if "day" in self.free else 62

    def next_fire(self, at: Column) -> Column:
        """next_after() of a column."""
        times = F.array(*[F.lit(m) for m in self.minutes])
        day, minute = _day_of(at), _minute_of(at)
        today = F.when(self.on_date(_date_of(day)), F.array_min(F.filter(times, lambda m: m > minute)))
        ahead = F.get(F.filter(F.sequence(F.lit(1), F.lit(self.reach)), lambda k: self.on_date(_date_of(day + k))), F.lit(0))
        found = F.coalesce(day * F.lit(DAY) + today * 60, (day + ahead) * F.lit(DAY) + F.lit(self.minutes[0] * 60))
        first = F.floor(at / 60) * 60 + 60
        return F.when(found < first + SEARCH_DAYS * DAY, found.cast("double"))

    def previous_fire(self, at: Column) -> Column:
        """previous_before() of a column."""
        times = F.array(*[F.lit(m) for m in self.minutes])
        # Strictly before: the last minute that begins before the instant.
        last = F.ceil(at / 60) * 60 - 60
        day, minute = _day_of(last), _minute_of(last)
        today = F.when(self.on_date(_date_of(day)), F.array_max(F.filter(times, lambda m: m <= minute)))
        back = F.get(F.filter(F.sequence(F.lit(1), F.lit(self.reach)), lambda k: self.on_date(_date_of(day - k))), F.lit(0))
        found = F.coalesce(day * F.lit(DAY) + today * 60, (day - back) * F.lit(DAY) + F.lit(self.minutes[-1] * 60))
        return F.when(found > last - SEARCH_DAYS * DAY, found.cast("double"))

    def fires(self, spark: SparkSession, start: float, end: float) -> DataFrame:
        """at: every fire in (start, end]."""
        if end < start:
            raise ValueError("end must not be before start")
        days = spark.range(math.floor(start / DAY), math.floor(end / DAY) + 1).select(F.col("id").cast("int").alias("day"))
        days = days.where(self.on_date(_date_of(F.col("day"))))
        found = days.select("day", F.explode(F.array(*[F.lit(m) for m in self.minutes])).alias("minute"))
        return found.select((F.col("day") * F.lit(DAY) + F.col("minute") * 60).cast("double").alias("at")).where((F.col("at") > start) & (F.col("at") <= end))

    def describe(self) -> str:
        return f"cron {self.source}"

    def summary(self) -> dict[str, str]:
        return {n: "*" if n in self.free else ",".join(map(str, v)) for n, v in self.fields.items()}


# Other triggers ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Interval:
    """anchor, anchor + every, ...; at most limit fires."""

    every: float
    anchor: float = 0.0
    limit: int | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "every", coerce_duration(self.every))
        if not self.every or self.every <= 0 or self.limit is not None and self.limit < 1:
            raise ScheduleError("an interval is positive, and its limit 1 or more")

    def next_after(self, at: float) -> float | None:
        n = 0 if at < self.anchor - 1e-9 else math.floor((at - self.anchor) / self.every + 1e-9) + 1
        return self.anchor + n * self.every if self.limit is None or n < self.limit else None

    def next_fire(self, at: Column) -> Column:
        n = F.when(at < self.anchor - 1e-9, F.lit(0)).otherwise(F.floor((at - self.anchor) / self.every + 1e-9) + 1)
        found = F.lit(float(self.anchor)) + n * F.lit(float(self.every))
        return found if self.limit is None else F.when(n < self.limit, found)

    def occurrence(self, at: float) -> int | None:
        """The number of the fire at an instant, if there is one."""
        n = (at - self.anchor) / self.every
        good = abs(n - round(n)) <= 1e-6 and round(n) >= 0 and (self.limit is None or round(n) < self.limit)
        return round(n) if good else None

    def occurrence_at(self, at: Column) -> Column:
        """occurrence() of a column."""
        n = (at - self.anchor) / self.every
        near = F.rint(n)
        good = (F.abs(n - near) <= 1e-6) & (near >= 0)
        return F.when(good if self.limit is None else good & (near < self.limit), near.cast("long"))

    def fires(self, spark: SparkSession, start: float, end: float) -> DataFrame:
        first = 0 if start < self.anchor - 1e-9 else math.floor((start - self.anchor) / self.every + 1e-9) + 1
        last = math.floor((end - self.anchor) / self.every + 1e-9)
        last = last if self.limit is None else min(last, self.limit - 1)
        at = (F.lit(float(self.anchor)) + F.col("id") * F.lit(float(self.every))).alias("at")
        return spark.range(first, max(first, last + 1)).select(at).where(F.col("at") <= end)

    def describe(self) -> str:
        parts = [f"every {format_duration(self.every)}"]
        if self.anchor:
            parts.append(f"from {iso_text(self.anchor)}")
        return " ".join(parts) + (f" (at most {self.limit} times)" if self.limit is not None else "")


@dataclass(frozen=True)
class Once:
    at: float

    def next_after(self, at: float) -> float | None:
        return float(self.at) if at < self.at - 1e-9 else None

    def next_fire(self, at: Column) -> Column:
        return F.when(at < self.at - 1e-9, F.lit(float(self.at)))

    def fires(self, spark: SparkSession, start: float, end: float) -> DataFrame:
        return spark.range(1).select(F.lit(float(self.at)).alias("at")).where(F.lit(start < self.at - 1e-9 and self.at <= end))

    def describe(self) -> str:
        return f"once at {iso_text(self.at)}"


@dataclass(frozen=True)
class Never:
    def next_after(self, at: float) -> float | None:
        return None

    def next_fire(self, at: Column) -> Column:
        return F.lit(None).cast("double")

    def fires(self, spark: SparkSession, start: float, end: float) -> DataFrame:
        return spark.range(0).select(F.lit(0.0).alias("at"))

    def describe(self) -> str:
        return "manual only"


def make_trigger(spec):
    """A trigger from cron text, a macro, a duration ("30s", "every 30s"), seconds, "never" or None; a trigger stays itself."""
    if spec is None or isinstance(spec, str) and spec.strip().lower() in ("", "never", "manual", "none"):
        return Never()
    if isinstance(spec, bool):
        raise ScheduleError("a boolean is no schedule")
    if isinstance(spec, (int, float)):
        return Interval(float(spec))
    if not isinstance(spec, str):
        if hasattr(spec, "next_after"):
            return spec
        raise ScheduleError(f"cannot make a schedule of {spec!r}")
    text = spec.strip()
    if text.startswith("@") or len(text.split()) == 5:
        return Cron.parse(text)
    try:
        return Interval(coerce_duration(re.sub(r"(?i)^every\s+", "", text)))
    except ValueError as e:
        raise ScheduleError(str(e)) from e


def iter_fires(trigger, start: float, count: int) -> list[float]:
    """The next count fires after start."""
    if count < 0:
        raise ValueError("count must not be negative")
    out: list[float] = []
    while len(out) < count and (found := trigger.next_after(out[-1] if out else float(start))) is not None:
        out.append(found)
    return out


# Calendars -----------------------------------------------------------------------------------------------------------


def parse_window(text: str) -> tuple[int, int]:
    """Minutes of the day at which HH:MM-HH:MM opens and closes; it wraps past midnight if it closes first."""
    m = re.fullmatch(r"(\d{1,2}):(\d{2})\s*-\s*(\d{1,2}):(\d{2})", text.strip()) if isinstance(text, str) else None
    if m is None or int(m[1]) > 24 or int(m[3]) > 24 or int(m[2]) > 59 or int(m[4]) > 59:
        raise ScheduleError(f"not a window: {text!r}")
    start, end = int(m[1]) * 60 + int(m[2]), int(m[3]) * 60 + int(m[4])
    if start == end or max(start, end) > 1440:
        raise ScheduleError(f"an empty or overlong window: {text!r}")
    return start, end


def in_window(minute: int, window: tuple[int, int]) -> bool:
    start, end = window
    return start <= minute < end if start < end else minute >= start or minute < end


@dataclass(frozen=True)
class Calendar:
    """Days off by weekday (Monday is 0) and date, and windows of the day; no window means all day."""

    name: str = "always"
    weekend: frozenset[int] = frozenset()
    holidays: frozenset[date] = frozenset()
    windows: tuple[tuple[int, int], ...] = ()

    @classmethod
    def of(cls, name: str = "business", weekend=("sat", "sun"), holidays=(), windows=()) -> Calendar:
        def weekday(d) -> int:
            if isinstance(d, int) and not isinstance(d, bool) and 0 <= d <= 6:
                return d
            if str(d).strip().lower()[:3] not in WEEKDAYS:
                raise ScheduleError(f"not a weekday: {d!r}")
            return (WEEKDAYS[str(d).strip().lower()[:3]] + 6) % 7

        try:
            days = frozenset(d if isinstance(d, date) else date.fromisoformat(d) for d in holidays)
        except (TypeError, ValueError) as e:
            raise ScheduleError(f"not a date: {e}") from e
        return cls(name, frozenset(map(weekday, weekend)), days, tuple(w if isinstance(w, tuple) else parse_window(w) for w in windows))

    def business(self, day: date) -> bool:
        return day.weekday() not in self.weekend and day not in self.holidays

    def business_date(self, day: Column) -> Column:
        """business() of a date column."""
        fits = ~F.weekday(day).isin(*self.weekend) if self.weekend else F.lit(True)
        return fits & ~day.isin(*sorted(self.holidays)) if self.holidays else fits

    def describe(self) -> str:
        names = {(v + 6) % 7: k for k, v in WEEKDAYS.items()}
        said = ["closed " + ",".join(names[d] for d in sorted(self.weekend))] if self.weekend else []
        said += [f"{len(self.holidays)} holiday(s)"] if self.holidays else []
        said += ["open " + ",".join(f"{a // 60:02d}:{a % 60:02d}-{b // 60:02d}:{b % 60:02d}" for a, b in self.windows)] if self.windows else []
        return f"{self.name}: " + ("; ".join(said) or "always open")

    def is_open(self, at: float) -> bool:
        moment = _utc(at)
        return self.business(moment.date()) and self._in(moment.hour * 60 + moment.minute)

    @property
    def reach(self) -> int:
        """Days within which a business day lies: of h + 1 weeks' working days h at most are holidays."""
        return min(ALIGN_DAYS - 1, 7 * (len(self.holidays) + 1)) if len(self.weekend) < 7 else ALIGN_DAYS - 1

    def _in(self, minute: int) -> bool:
        return not self.windows or any(in_window(minute, w) for w in self.windows)

    def open_at(self, at: Column) -> Column:
        m = _minute_of(at)
        tests = [((m >= a) & (m < b)) if a < b else ((m >= a) | (m < b)) for a, b in self.windows]
        return self.business_date(_date_of(_day_of(at))) & (reduce(lambda x, y: x | y, tests) if tests else F.lit(True))

    def _first_minute(self) -> int | None:
        """The first open minute of a business day."""
        return next((m for m in range(1440) if self._in(m)), None)

    def align(self, at: float) -> float:
        """The instant itself if open; else the first open minute after it."""
        if self.is_open(at):
            return float(at)
        moment = _utc(at)
        day, minute = moment.date(), moment.hour * 60 + moment.minute
        for _ in range(ALIGN_DAYS):
            found = next((m for m in range(minute, 1440) if self._in(m)), None) if self.business(day) else None
            if found is not None:
                return (datetime(day.year, day.month, day.day, tzinfo=UTC) + timedelta(minutes=found)).timestamp()
            day, minute = day + timedelta(days=1), 0
        raise ScheduleError(f"calendar {self.name!r} never opens")

    def aligned(self, at: Column) -> Column:
        """align() of a column: later today at a window's start, or on the next business day at its first open minute."""
        day, minute = _day_of(at), _minute_of(at)
        starts = F.array(*[F.lit(a) for a, _ in self.windows]) if self.windows else F.array().cast("array<int>")
        today = F.when(self.business_date(_date_of(day)), F.array_min(F.filter(starts, lambda s: (s >= minute) & (s < 1440))))
        ahead = F.get(F.filter(F.sequence(F.lit(1), F.lit(self.reach)), lambda k: self.business_date(_date_of(day + k))), F.lit(0))
        later = (day + ahead) * F.lit(DAY) + F.lit((self._first_minute() or 0) * 60)
        found = F.coalesce(day * F.lit(DAY) + today * 60, later).cast("double")
        return F.when(self.open_at(at), at.cast("double")).otherwise(F.coalesce(found, F.raise_error(F.lit(f"calendar {self.name} never opens")).cast("double")))

    def next_business_day(self, at: float) -> float:
        day = _utc(at).date()
        for n in range(1, ALIGN_DAYS + 1):
            if self.business(day + timedelta(days=n)):
                d = day + timedelta(days=n)
                return datetime(d.year, d.month, d.day, tzinfo=UTC).timestamp()
        raise ScheduleError(f"calendar {self.name!r} has no business days")

    def next_business_at(self, at: Column) -> Column:
        day = _day_of(at)
        ahead = F.get(F.filter(F.sequence(F.lit(1), F.lit(self.reach)), lambda k: self.business_date(_date_of(day + k))), F.lit(0))
        return ((day + ahead) * F.lit(DAY)).cast("double")

    def business_days_between(self, start: float, end: float) -> int:
        if end < start:
            raise ValueError("end must not be before start")
        first, last = _utc(start).date(), _utc(end).date()
        return sum(self.business(first + timedelta(days=n)) for n in range((last - first).days))

    def business_days(self, start: Column, end: Column) -> Column:
        """Business days in [start, end) by date, of columns of instants."""
        a, b = _day_of(start), _day_of(end)
        days = F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(days, lambda d: self.business_date(_date_of(d))))


def merge_calendars(name: str, calendars: list[Calendar]) -> Calendar:
    """Open where all are: days off add up, windows intersect by minute; windows that don't meet leave none, which means all day."""
    limited = [c for c in calendars if c.windows]
    windows = limited[0].windows if limited else ()
    if len(limited) > 1:
        open_ = [all(c._in(m) for c in limited) for m in range(1440)] + [False]
        starts = [m for m in range(1440) if open_[m] and (m == 0 or not open_[m - 1])]
        windows = tuple((m, next(n for n in range(m, 1441) if not open_[n])) for m in starts)
    return Calendar(name, frozenset().union(*[c.weekend for c in calendars]), frozenset().union(*[c.holidays for c in calendars]), windows)


# Timetables ----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Entry:
    """A trigger that starts a workflow; fires while its calendar is closed are skipped or deferred to its opening."""

    name: str
    workflow: str
    trigger: object
    calendar: Calendar = Calendar()
    params: dict = field(default_factory=dict)
    enabled: bool = True
    on_closed: str = "skip"

    def __post_init__(self) -> None:
        if self.on_closed not in ("skip", "defer"):
            raise ScheduleError("on_closed is skip or defer")

    def next_after(self, at: float) -> float | None:
        for _ in range(SKIPS if self.enabled else 0):
            at = self.trigger.next_after(at)
            if at is None or self.calendar.is_open(at):
                return at
            if self.on_closed == "defer":
                return self.calendar.align(at)
        if not self.enabled:
            return None
        raise ScheduleError(f"{self.name!r} skipped {SKIPS} fires in a row")

    def describe(self) -> str:
        said = [f"{self.name} -> {self.workflow}", self.trigger.describe()]
        if self.calendar != Calendar():
            said += [self.calendar.describe(), f"on closed: {self.on_closed}"]
        return " | ".join(said) + ("" if self.enabled else " [disabled]")

    def fires(self, spark: SparkSession, start: float, end: float) -> DataFrame:
        """at, in (start, end]; a deferred fire takes those with it that fall into the same closed time."""
        if not self.enabled:
            return Never().fires(spark, start, end)
        found = self.trigger.fires(spark, start, end)
        if self.on_closed == "skip":
            return found.where(self.calendar.open_at(F.col("at")))
        return found.select(self.calendar.aligned(F.col("at")).alias("at")).distinct().where(F.col("at") <= end)


class Timetable:
    """Entries in order of declaration, which breaks ties between fires."""

    def __init__(self, entries: list[Entry] = ()):
        self.entries: list[Entry] = []
        for e in entries:
            self.add(e)

    def add(self, entry: Entry) -> Timetable:
        if any(e.name == entry.name for e in self.entries):
            raise ScheduleError(f"there is a schedule {entry.name!r} already")
        self.entries.append(entry)
        return self

    def remove(self, name: str) -> None:
        self.entries.remove(self.get(name))

    def get(self, name: str) -> Entry:
        for e in self.entries:
            if e.name == name:
                return e
        raise ScheduleError(f"no schedule {name!r}")

    def enable(self, name: str, on: bool = True) -> None:
        from dataclasses import replace

        self.entries[self.entries.index(self.get(name))] = replace(self.get(name), enabled=on)

    def for_workflow(self, workflow: str) -> list[Entry]:
        return [e for e in self.entries if e.workflow == workflow]

    def next_fire(self, at: float) -> tuple[float, Entry] | None:
        found = [(t, n) for n, e in enumerate(self.entries) if (t := e.next_after(at)) is not None]
        return (min(found)[0], self.entries[min(found)[1]]) if found else None

    def between(self, spark: SparkSession, start: float, end: float, limit: int = 10_000) -> DataFrame:
        """at, schedule, pos, workflow: all fires in (start, end] in order, limit at most."""
        if end < start:
            raise ValueError("end must not be before start")
        parts = [e.fires(spark, start, end).select("at", F.lit(e.name).alias("schedule"), F.lit(n).alias("pos"), F.lit(e.workflow).alias("workflow")) for n, e in enumerate(self.entries)]
        if not parts:
            return spark.createDataFrame([], "at double, schedule string, pos int, workflow string")
        return reduce(DataFrame.unionByName, parts).orderBy("at", "pos").limit(limit)

    def upcoming(self, at: float, count: int) -> list[tuple[float, Entry]]:
        """The next count fires of all entries."""
        out, heads = [], [e.next_after(at) for e in self.entries]
        while len(out) < count and any(h is not None for h in heads):
            t, n = min((h, n) for n, h in enumerate(heads) if h is not None)
            out.append((t, self.entries[n]))
            heads[n] = self.entries[n].next_after(t)
        return out
