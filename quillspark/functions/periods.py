"""Calendar periods and back-off times (P6, P7, P19, Q4, Q5, Q11). Business days are days at a fixed offset of eight hours."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = timezone(timedelta(hours=8))
# Words for periods, as (unit, units from the current one).
WORDS = {"今天": ("day", 0), "昨天": ("day", -1), "本周": ("week", 0), "上周": ("week", -1), "本月": ("month", 0), "这个月": ("month", 0), "上月": ("month", -1), "上个月": ("month", -1), "今年": ("year", 0), "去年": ("year", -1)}


def _floor(t: datetime, unit: str) -> datetime:
    t = t.replace(hour=0, minute=0, second=0, microsecond=0)
    if unit == "week":
        return t - timedelta(days=t.weekday())
    return t.replace(day=1, month=1) if unit == "year" else t.replace(day=1) if unit == "month" else t


def _shift(t: datetime, unit: str, n: int) -> datetime:
    if unit in ("day", "week"):
        return t + timedelta(days=n * (7 if unit == "week" else 1))
    months = t.year * 12 + t.month - 1 + n * (12 if unit == "year" else 1)
    return t.replace(year=months // 12, month=months % 12 + 1)


def period(text: str, now: datetime) -> tuple[datetime, datetime]:
    """[start, end) of a word or of a year, month or day; ValueError for anything else."""
    text = text.strip()
    if text in WORDS:
        unit, n = WORDS[text]
        start = _shift(_floor(now.astimezone(ZONE), unit), unit, n)
        return start, _shift(start, unit, 1)
    parts = re.fullmatch(r"(\d{4})(?:[年/-]?(\d{1,2})(?:[月/-]?(\d{1,2})日?|月|[/-])?|[年/-])?", text)
    if not parts:
        raise ValueError(f"no period: {text!r}")
    given = [int(x) for x in parts.groups() if x]
    start = datetime(*(given + [1] * (3 - len(given))), tzinfo=ZONE)
    return start, _shift(start, ("year", "month", "day")[len(given) - 1], 1)


def date_bounds(operator: str, text: str, now: datetime) -> tuple[datetime | None, datetime | None]:
    """A comparison with a period as half-open bounds. Not-equal is refused, as it is no single interval."""
    start, end = period(text, now)
    bounds = {"eq": (start, end), "range": (start, end), "gte": (start, None), "gt": (end, None), "lt": (None, start), "lte": (None, end)}
    if operator not in bounds:
        raise ValueError(f"{operator} does not go with a period")
    return bounds[operator]


# What stands between the ends of a range, and an instant with its zone.
BETWEEN_DATES = r"\s*(?:至|到|~|～|\s+-\s+)\s*"
INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?$"
_CALENDAR = r"^(\d{4})(?:年|[-/])?(?:(\d{1,2})(?:月|[-/])?)?(?:(\d{1,2})日?)?$"


def _with_period(rows: DataFrame, name: str, text: Column, now: str) -> DataFrame:
    """P6 as a column `name`: struct of start and end (UTC, half-open), nulls for what is no period. now: a column of UTC times."""
    number = lambda i: F.try_to_number(F.nullif(F.regexp_extract("_t", _CALENDAR, i), F.lit("")), F.lit("9999")).cast("int")
    r = rows.withColumn("_t", F.trim(text)).withColumns({"_y": number(1), "_m": number(2), "_d": number(3), "_unit": F.try_element_at(F.create_map(*[F.lit(x) for w, v in WORDS.items() for x in (w, v[0])]), F.col("_t")), "_n": F.try_element_at(F.create_map(*[F.lit(x) for w, v in WORDS.items() for x in (w, F.lit(v[1]))]), F.col("_t"))})
    unit = F.coalesce("_unit", F.when(F.col("_d").isNotNull(), "day").when(F.col("_m").isNotNull(), "month").otherwise("year"))
    dated = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", "_y", F.coalesce("_m", F.lit(1)), F.coalesce("_d", F.lit(1)))).cast("date")
    today = F.call_function("date_trunc", F.col("_unit"), F.col(now) + F.expr("INTERVAL 8 HOURS")).cast("date")
    r = r.withColumns({"_unit": unit, "_n": F.coalesce("_n", F.lit(0)), "_day": F.when(F.col("_unit").isNotNull(), today).when(F.col("_y").isNotNull(), dated)})
    months = F.when(F.col("_unit") == "year", 12).when(F.col("_unit") == "month", 1).otherwise(0)
    days = F.when(F.col("_unit") == "week", 7).when(F.col("_unit") == "day", 1).otherwise(0)
    at = lambda n: F.date_add(F.add_months("_day", n * months), n * days).cast("timestamp") - F.expr("INTERVAL 8 HOURS")
    return r.withColumn(name, F.struct(at(F.col("_n")).alias("start"), at(F.col("_n") + 1).alias("end"))).drop("_t", "_y", "_m", "_d", "_unit", "_n", "_day")


def with_periods(rows: DataFrame, text: str, now: str) -> DataFrame:
    """Rows with `start` and `end` of the period that text names, nulls where it names none."""
    return _with_period(rows, "_p", F.col(text), now).select(*rows.columns, F.col("_p.start").alias("start"), F.col("_p.end").alias("end"))


def date_conditions(rows: DataFrame, now: str) -> DataFrame:
    """Rows (operator, value, instants, ...; now: a column of UTC times) with op (range, gte, gt, lt, lte, eq, neq), lower and
    upper (UTC times; which of them counts follows from op, both for a range, half-open) and code, which names what is wrong with
    the condition, the rest then being null.

    A value with a T is an instant where instants are allowed (a time of uploading, not a day of an event) and compares as it
    is; it needs a zone. Else the value is a period, or in a range one or two of them with a sign between."""
    r = rows.withColumn("_parts", F.split("value", BETWEEN_DATES))
    range_ = F.col("operator") == "range"
    r = _with_period(r, "_one", F.when(range_, F.get("_parts", 0)).otherwise(F.col("value")), now)
    r = _with_period(r, "_two", F.coalesce(F.get("_parts", 1), F.lit("")), now)
    r = r.withColumns({
        "_start": F.col("_one.start"), "_end": F.when(range_ & (F.size("_parts") == 2), F.col("_two.end")).otherwise(F.col("_one.end")),
        "_instant": F.col("instants") & F.contains("value", F.lit("T")) & ~range_, "_at": F.when(F.col("value").rlike(INSTANT), F.try_to_timestamp("value")),
    })
    instant, operator = F.col("_instant"), F.col("operator")
    code = (
        F.when(~operator.isin("eq", "neq", "gt", "gte", "lt", "lte", "range"), "OPERATOR_INVALID")
        .when(instant & F.col("_at").isNull(), "INSTANT_INVALID")
        .when(instant & (F.regexp_extract("value", INSTANT, 1) == ""), "ZONE_MISSING")
        .when(instant, F.lit(None).cast("string"))
        .when(range_ & (F.size("_parts") > 2), "RANGE_INVALID")
        .when(F.col("_start").isNull() | F.col("_end").isNull(), "PERIOD_INVALID")
        .when(range_ & (F.col("_start") >= F.col("_end")), "RANGE_EMPTY")
        .when(operator == "neq", "NOT_EQUAL_UNSUPPORTED")
    )
    # a period ends before its end: up to it is before that, after it is from there on
    op = F.when(instant, operator).when(operator.isin("eq", "range"), "range").when(operator == "gt", "gte").when(operator == "lte", "lt").otherwise(operator)
    lower = F.when(instant, F.col("_at")).when(operator == "gt", F.col("_end")).when(operator.isin("eq", "range", "gte"), F.col("_start"))
    upper = F.when(instant, F.col("_at")).when(operator == "lt", F.col("_start")).when(operator.isin("eq", "range", "lte"), F.col("_end"))
    r = r.withColumn("code", code)
    return r.select(*rows.columns, *[F.when(F.col("code").isNull(), c).alias(n) for n, c in (("op", op), ("lower", lower), ("upper", upper))], "code")


def local_day(ts: Column) -> Column:
    """The business day of a UTC time."""
    return F.to_date(ts + F.expr("INTERVAL 8 HOURS"))


def backoff(attempt: Column, first: int = 15, most: int = 300, doublings: int | None = None) -> Column:
    """Q4, Q5, Q11: seconds before attempt n + 1: first * 2 ** (n - 1), at most `most`."""
    n = attempt - 1
    n = n if doublings is None else F.least(n, F.lit(doublings))
    return F.least(F.lit(most), (F.lit(first) * F.pow(F.lit(2.0), n)).cast("long"))
