"""Scalar helpers: durations, stamps, ids, names and text, for Python values and, where it makes sense, for columns."""

from __future__ import annotations

import hashlib
import json
import math
import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.faults import MissingParameter, ParameterError, ParameterType

#: Seconds of each unit of a duration, the largest first; a number without a unit is in seconds.
UNITS = {"w": 604800.0, "d": 86400.0, "h": 3600.0, "m": 60.0, "s": 1.0, "ms": 0.001, "us": 0.000001}
UNIT_NAMES = {"w": "week", "d": "day", "h": "hour", "m": "minute", "s": "second"}
PART = r"(\d+(?:\.\d+)?)\s*(us|ms|[wdhms])?"

MAX_NAME = 96
NAME, TAG = r"^[A-Za-z][A-Za-z0-9_.-]*$", r"^[A-Za-z0-9][A-Za-z0-9_.:-]*$"
RESERVED = ("params", "results", "run", "task", "now", "self")


# Durations -----------------------------------------------------------------------------------------------------------


def parse_duration(text: str) -> float:
    """Seconds of a text such as 1h30m, -5m or 250ms; parts add up, in any order."""
    whole = re.fullmatch(rf"\s*([+-]?)\s*((?:{PART}\s*)+)", text) if isinstance(text, str) else None
    if whole is None:
        raise ValueError(f"not a duration: {text!r}")
    total = sum(float(n) * UNITS[u or "s"] for n, u in re.findall(PART, whole[2]))
    return -total if whole[1] == "-" else total


def coerce_duration(value, default: float | None = None) -> float | None:
    """Seconds of a number or a text; default for None."""
    if value is None:
        return default
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    return parse_duration(value)


def duration_seconds(text: Column) -> Column:
    """parse_duration() of a column; null stays null, malformed text is an error."""
    body = F.regexp_replace(text, r"^\s*[+-]?\s*", "")
    numbers = F.regexp_extract_all(body, F.lit(PART), F.lit(1))
    units = F.regexp_extract_all(body, F.lit(PART), F.lit(2))
    factor = F.create_map(*[x for u, s in UNITS.items() for x in (F.lit(u), F.lit(s))], F.lit(""), F.lit(1.0))
    parts = F.zip_with(numbers, units, lambda n, u: n.cast("double") * F.element_at(factor, u))
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    sign = F.when(F.ltrim(F.regexp_replace(text, r"^\s+", "")).startswith("-"), -1.0).otherwise(1.0)
    good = text.rlike(rf"^\s*[+-]?\s*({PART}\s*)+$")
    return F.when(text.isNull(), F.lit(None).cast("double")).when(good, sign * total).otherwise(F.raise_error(F.concat(F.lit("not a duration: "), text)))


def _short(x: float) -> str:
    x = round(x, 6)
    return str(int(x)) if x == int(x) else f"{x:g}"


def format_duration(seconds: float, precision: int = 2) -> str:
    """The largest units of a duration, at most precision of them: 1h30m, 250ms, 0s."""
    if precision < 1:
        raise ValueError("precision must be 1 or more")
    if seconds < 0:
        return "-" + format_duration(-seconds, precision)
    if seconds == 0:
        return "0s"
    if seconds < 1:
        return f"{_short(seconds * 1e3)}ms" if seconds * 1e3 >= 1 else f"{_short(seconds * 1e6)}us"
    out, left = [], float(seconds)
    for unit in UNIT_NAMES:
        size = UNITS[unit]
        if left >= size and len(out) < precision:
            n, left = int(left // size), left - int(left // size) * size
            out.append(f"{_short(n + left)}s" if unit == "s" and left else f"{n}{unit}")
    return "".join(out)


def humanize_duration(seconds: float) -> str:
    """A duration in words: 1 hour 30 minutes."""
    if seconds < 0:
        return "-" + humanize_duration(-seconds)
    if seconds < 1:
        millis = _short(round(seconds * 1e3, 3))
        return "1 millisecond" if millis == "1" else f"{millis} milliseconds"
    out, left = [], float(seconds)
    for unit, name in UNIT_NAMES.items():
        n = int(left // UNITS[unit])
        left -= n * UNITS[unit]
        if n:
            out.append(pluralize(n, name))
    return " ".join(out) or "0 seconds"


def _digits(value: Column) -> Column:
    """A number from 0 on with six significant digits at most and no zeros at its end, as _short() writes it."""
    places = lambda n: F.regexp_replace(F.format_string(f"%.{n}f", F.round(value, n)), r"\.?0+$", "")
    return F.when(value >= 100, places(3)).when(value >= 10, places(4)).otherwise(F.when(value == 0, "0").otherwise(places(5)))


def _counts_of(seconds: Column) -> list[tuple[str, Column]]:
    """(unit, how many of it) of a duration of 0 or more, the largest unit first; the seconds keep their fraction."""
    left, out = seconds, []
    for unit in UNIT_NAMES:
        size = F.lit(UNITS[unit])
        out.append((unit, left if unit == "s" else F.floor(left / size)))
        left = left % size
    return out


def duration_text(seconds: Column, precision: int = 2) -> Column:
    """format_duration() of a column; null stays null. Seconds are cut to whole ones unless they are the last unit that fits."""
    if precision < 1:
        raise ValueError("precision must be 1 or more")
    size = F.abs(seconds)
    parts = F.array(*[F.when(n > 0, F.concat(_digits(n) if u == "s" else n.cast("string"), F.lit(u))) for u, n in _counts_of(size)])
    text = F.array_join(F.slice(F.array_compact(parts), 1, precision), "")
    below = F.when(size >= 0.001, F.concat(_digits(size * 1e3), F.lit("ms"))).otherwise(F.concat(_digits(size * 1e6), F.lit("us")))
    text = F.when(size == 0, "0s").when(size < 1, below).otherwise(text)
    return F.when(seconds.isNotNull(), F.concat(F.when(seconds < 0, "-").otherwise(""), text))


def duration_words(seconds: Column) -> Column:
    """humanize_duration() of a column; null stays null."""
    size = F.abs(seconds)
    named = lambda n, name: F.when(n > 0, F.concat(n.cast("string"), F.when(n == 1, f" {name}").otherwise(f" {name}s")))
    words = F.array_join(F.array_compact(F.array(*[named(F.floor(n), UNIT_NAMES[u]) for u, n in _counts_of(size)])), " ")
    millis = _digits(F.round(size * 1e3, 3))
    words = F.when(size < 1, F.concat(millis, F.when(millis == "1", " millisecond").otherwise(" milliseconds"))).otherwise(words)
    return F.when(seconds.isNotNull(), F.concat(F.when(seconds < 0, "-").otherwise(""), words))


# Stamps and ids ------------------------------------------------------------------------------------------------------


def iso(at: Column) -> Column:
    """2026-03-11T09:00:00Z of epoch seconds; the session's time zone must be UTC."""
    return F.date_format(F.timestamp_seconds(F.floor(at)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def compact(at: Column) -> Column:
    """20260311T090000Z of epoch seconds."""
    return F.date_format(F.timestamp_seconds(F.floor(at)), "yyyyMMdd'T'HHmmss'Z'")


def iso_text(at: float) -> str:
    return datetime.fromtimestamp(at, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def slug(text: Column, most: int = 48) -> Column:
    """Lower-case letters and digits, everything else one hyphen, at most so long; x if nothing is left."""
    cleaned = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.left(cleaned, F.lit(most)), "-+$", "")
    return F.when(cut == "", "x").otherwise(cut)


def short_hash(text: Column, length: int = 8) -> Column:
    if not 4 <= length <= 64:
        raise ValueError("length must lie between 4 and 64")
    return F.left(F.sha2(text, 256), F.lit(length))


def run_ids(rows, workflow: str, at: str, arrival: str):
    """rows with run_id: slug, stamp and a number that counts the runs of both, in order of arrival."""
    from pyspark.sql import Window

    keyed = rows.withColumn("_slug", slug(F.col(workflow))).withColumn("_stamp", compact(F.col(at)))
    n = F.row_number().over(Window.partitionBy("_slug", "_stamp").orderBy(arrival))
    number = F.when(n < 10_000, F.lpad(n.cast("string"), 4, "0")).otherwise(n.cast("string"))
    return keyed.withColumn("run_id", F.concat_ws("-", "_slug", "_stamp", number)).drop("_slug", "_stamp")


# Canonical JSON ------------------------------------------------------------------------------------------------------


def canonical(value, indent: int | None = None) -> str:
    """JSON with sorted keys; without an indent as short as can be. Infinities are an error; what JSON lacks becomes text."""
    spread = None if indent is not None else (",", ":")
    return json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False, indent=indent, separators=spread, default=str)


def json_equal(a, b) -> bool:
    return canonical(a) == canonical(b)


def content_hash(value, length: int = 12) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()[:length]


# Names ---------------------------------------------------------------------------------------------------------------


def valid_name(name: Column) -> Column:
    return name.rlike(NAME) & (F.length(name) <= MAX_NAME)


def check_name(name: str, what: str = "task") -> str:
    """The name, or an error: names of tasks may not be those that conditions read."""
    if not isinstance(name, str) or len(name) > MAX_NAME or not re.fullmatch((TAG if what == "tag" else NAME).strip("^$"), name):
        raise ValueError(f"not a {what} name: {name!r}")
    if what == "task" and name in RESERVED:
        raise ValueError(f"{name!r} is reserved")
    return name


def qualify(workflow: Column, task: Column) -> Column:
    return F.concat_ws("::", workflow, task)


def split_qualified(name: Column) -> Column:
    """struct<workflow, task> of workflow::task; null if the name isn't made so."""
    parts = F.split(name, "::")
    return F.when((F.size(parts) == 2) & (parts[0] != "") & (parts[1] != ""), F.struct(parts[0].alias("workflow"), parts[1].alias("task")))


# Parameters ----------------------------------------------------------------------------------------------------------

TRUE_WORDS, FALSE_WORDS = ("true", "yes", "on", "1"), ("false", "no", "off", "0")
PARAM_TYPES = ("string", "integer", "number", "boolean", "list", "object", "any")


def coerce_param(kind: str, value):
    """A parameter's value as its declared type; a boolean is never a number."""
    text = value.strip().lower() if isinstance(value, str) else None
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "any" or kind == "string" and text is not None:
        return value
    if kind == "boolean" and (isinstance(value, bool) or text in TRUE_WORDS + FALSE_WORDS):
        return value if text is None else text in TRUE_WORDS
    if kind in ("integer", "number"):
        try:
            if text is not None:
                return int(text, 10) if kind == "integer" else float(text)
            if number and (kind == "number" or float(value).is_integer()):
                return int(value) if kind == "integer" else float(value)
        except ValueError:
            pass
    if kind == "list" and isinstance(value, (list, tuple)):
        return list(value)
    if kind == "object" and isinstance(value, dict):
        return dict(value)
    raise ParameterType(f"expected {kind}, got {value!r}")


def bind_params(schema: dict[str, dict], given: dict, allow_extra: bool = False) -> dict:
    """Values for all parameters of a schema (name -> type, required, default, choices) from what is given."""
    if unknown := [k for k in given if k not in schema]:
        if not allow_extra:
            raise ParameterError(f"unknown parameter {unknown[0]!r}", name=unknown[0])
    out = {}
    for name, spec in schema.items():
        if spec.get("type", "string") not in PARAM_TYPES:
            raise ParameterError(f"unknown type of {name!r}", name=name)
        if name in given:
            out[name] = coerce_param(spec.get("type", "string"), given[name])
        elif spec.get("required"):
            raise MissingParameter(f"missing parameter {name!r}", name=name)
        else:
            default = spec.get("default")
            out[name] = default if default is None else coerce_param(spec.get("type", "string"), default)
        choices = [coerce_param(spec.get("type", "string"), c) for c in spec.get("choices") or []]
        if choices and out[name] is not None and out[name] not in choices:
            raise ParameterError(f"{name!r} must be one of {spec['choices']}", name=name)
    return out | {k: v for k, v in given.items() if k not in schema}


# Text ----------------------------------------------------------------------------------------------------------------


def pluralize(n: int, one: str, many: str | None = None) -> str:
    return f"{n} {one if n == 1 else many or one + 's'}"


def join_human(items: list[str], word: str = "and") -> str:
    return f" {word} ".join([", ".join(items[:-1]), items[-1]]) if len(items) > 1 else "".join(items)


def truncate(text: str, width: int, mark: str = "...") -> str:
    if len(text) <= max(0, width):
        return text
    return text[: max(0, width)] if width <= len(mark) else text[: width - len(mark)] + mark


def pad(text: str, width: int, align: str = "left") -> str:
    sides = {"left": str.ljust, "right": str.rjust, "center": str.center}
    if align not in sides:
        raise ValueError(f"unknown alignment {align!r}")
    return sides[align](truncate(text, width), width)


def indent(text: str, by: str = "  ") -> str:
    return re.sub(r"(?m)^(?=.)", lambda _: by, text)


def wrap(text: str, width: int = 78) -> list[str]:
    if width <= 0:
        raise ValueError("width must be positive")
    lines = [""]
    for word in text.split():
        joined = f"{lines[-1]} {word}" if lines[-1] else word
        if lines[-1] and len(joined) > width:
            lines.append(word)
        else:
            lines[-1] = joined
    return lines


def columnize(rows: list[list[str]], gap: int = 2) -> list[str]:
    width = [max(len(r[i]) for r in rows if len(r) > i) for i in range(max(map(len, rows), default=0))]
    return [(" " * gap).join([*[c.ljust(w) for c, w in zip(r[:-1], width)], r[-1]]).rstrip() if r else "" for r in rows]


def bar(fraction: float, width: int = 20, full: str = "#", empty: str = ".") -> str:
    n = round(min(1.0, max(0.0, fraction)) * max(0, width))
    return full * n + empty * (max(0, width) - n)


def half_even(x: float, places: int = 0) -> float:
    return round(x, places) if math.isfinite(x) else x
