"""Parsers for list, mapping and opening-hours text, as pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed order in which a business is given its broad category.
MACRO_CATEGORIES = [
    "Restaurants", "Food", "Shopping", "Beauty & Spas", "Health & Medical", "Home Services", "Local Services",
    "Nightlife", "Automotive", "Active Life", "Event Planning & Services", "Arts & Entertainment", "Hotels & Travel",
    "Professional Services",
]


def tokens(text: Column, separator: str = ",") -> Column:
    """Trimmed, non-empty parts; null gives an empty array."""
    parts = F.filter(F.transform(F.split(text, separator), lambda t: F.trim(t)), lambda t: t != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def text_or(text: Column, default: str) -> Column:
    trimmed = F.trim(text.cast("string"))
    return F.when(trimmed != "", trimmed).otherwise(F.lit(default))


def _none_as_empty(text: Column) -> Column:
    return F.when(F.lower(F.trim(text)) != "none", text)


def friend_list(text: Column) -> Column:
    return tokens(_none_as_empty(text))


def friend_count(text: Column) -> Column:
    return F.size(friend_list(text)).cast("bigint")


def elite_years(text: Column) -> Column:
    return F.size(tokens(_none_as_empty(text), "[,;]")).cast("bigint")


def literal_to_json(text: Column) -> Column:
    """A Python dict literal rewritten as JSON.

    The text is cut into quoted strings and the rest. Strings are re-quoted; in the rest the constants are
    renamed and string prefixes and trailing commas dropped.
    """
    quote, double, back = "\\u0027", '"', "\\\\"
    piece = rf"'(?:[^'{back}]|{back}.)*'|\"(?:[^\"{back}]|{back}.)*\"|[^'\"]+"
    pieces = F.regexp_extract_all(text, F.lit(piece), F.lit(0))

    def rewrite(p):
        inner = p.substr(F.lit(2), F.length(p) - 2)
        single = F.concat(F.lit(double), F.replace(F.replace(inner, F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"')), F.lit(double))
        dq = F.concat(F.lit(double), F.replace(inner, F.lit("\\'"), F.lit("'")), F.lit(double))
        rest = F.regexp_replace(p, r"\bTrue\b", "true")
        rest = F.regexp_replace(rest, r"\bFalse\b", "false")
        rest = F.regexp_replace(rest, r"\bNone\b", "null")
        rest = F.regexp_replace(rest, r"[uUbB]$", "")
        rest = F.regexp_replace(rest, r",\s*\}", "}")
        return F.when(p.startswith("'"), single).when(p.startswith('"'), dq).otherwise(rest)

    return F.array_join(F.transform(pieces, rewrite), "")


def parse_mapping(text: Column) -> Column:
    """Top-level entries of a dict literal as a map of variants; anything else gives null."""
    trimmed = F.trim(text)
    json = F.when(trimmed.startswith("{"), literal_to_json(trimmed))
    return F.try_parse_json(json).try_cast("map<string,variant>")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def flat_attributes(text: Column) -> Column:
    """Attributes as an array of ``(key, value, kind)`` with kind bool, text, number or none.

    A value that is itself a mapping, or text that holds one, contributes dotted keys. Texts "true" and
    "false" count as booleans; other texts are trimmed.
    """

    kinds = F.transform(F.map_entries(parse_mapping(text)), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("v"), _kind(e["value"]).alias("kind")))
    inner = lambda e: F.when(e["kind"].startswith("OBJECT"), e["v"].try_cast("map<string,variant>")).when(e["kind"] == "STRING", parse_mapping(_as_text(e["v"])))
    entries = F.transform(kinds, lambda e: F.struct(e["key"].alias("key"), e["v"].alias("v"), e["kind"].alias("kind"), inner(e).alias("inner")))

    def cells(e):
        nested = F.transform(F.map_entries(e["inner"]), lambda n: F.struct(F.concat(e["key"], F.lit("."), n["key"]).alias("key"), n["value"].alias("v"), _kind(n["value"]).alias("kind")))
        return F.when(e["inner"].isNotNull(), nested).otherwise(F.array(F.struct(e["key"].alias("key"), e["v"].alias("v"), e["kind"].alias("kind"))))

    def scalar(c):
        is_text = c["kind"] == "STRING"
        flag = is_text & c["lowered"].isin("true", "false")
        return F.struct(
            c["key"].alias("key"),
            F.when(flag, c["lowered"]).when(is_text, F.trim(c["value"])).otherwise(c["value"]).alias("value"),
            F.when(flag, "bool")
            .when(is_text, "text")
            .when(c["kind"] == "BOOLEAN", "bool")
            .when(c["kind"] == "VOID", "none")
            .otherwise("number")
            .alias("kind"),
        )

    read = F.transform(F.flatten(F.transform(entries, cells)), lambda c: F.struct(c["key"].alias("key"), c["kind"].alias("kind"), _as_text(c["v"]).alias("value")))
    read = F.transform(read, lambda c: F.struct(c["key"].alias("key"), c["kind"].alias("kind"), c["value"].alias("value"), F.lower(F.trim(c["value"])).alias("lowered")))
    return F.coalesce(F.transform(read, scalar), F.array().cast("array<struct<key:string,value:string,kind:string>>"))


def attribute_text(value: Column, kind: Column) -> Column:
    """Canonical value text: whole numbers without a fraction, other numbers with four decimals."""
    number = value.try_cast("double")
    whole = number == F.floor(number)
    fraction = F.regexp_replace(F.format_string("%.4f", number), r"\.?0+$", "")
    return (
        F.when(kind == "number", F.when(whole, number.cast("bigint").cast("string")).otherwise(fraction))
        .when(F.length(F.trim(value)) > 0, F.trim(value))
        .otherwise("__unknown__")
    )


# A column expression is evaluated at each place that names it, inside lambdas too. Parsers therefore go in steps, and each step
# reads what the one before has put into a struct.


def _clock(text: Column) -> Column:
    """The two numbers of ``hours:minutes``; null without a colon."""
    hours = F.trim(F.substring_index(text, ":", 1)).try_cast("int")
    minutes = F.trim(F.substring(text, F.locate(":", text) + 1, F.length(text))).try_cast("int")
    return F.when(text.contains(":"), F.struct(hours.alias("h"), minutes.alias("m")))


def _minutes(clock: Column) -> Column:
    return F.when(clock["h"].between(0, 24) & clock["m"].between(0, 59), clock["h"] * 60 + clock["m"])


def _halves(interval: Column) -> tuple[Column, Column]:
    return F.substring_index(interval, "-", 1), F.substring(interval, F.locate("-", interval) + 1, F.length(interval))


def _length(dash: Column, start: Column, end: Column) -> Column:
    length = F.when(end == start, 1440).when(end < start, end + 1440 - start).otherwise(end - start)
    return F.when(dash & start.isNotNull() & end.isNotNull(), length).otherwise(0)


def _late(dash: Column, end: Column) -> Column:
    return F.coalesce(dash & ((end >= 1320) | (end <= 180)), F.lit(False))


def clock_minutes(text: Column) -> Column:
    """Minutes since midnight of ``hours:minutes``; null unless 0..24 hours and 0..59 minutes."""
    return _minutes(_clock(text))


def _ends(interval: Column) -> tuple[Column, Column]:
    start, end = _halves(interval)
    return clock_minutes(start), clock_minutes(end)


def interval_minutes(interval: Column) -> Column:
    """Length of ``start-end``, across midnight if the end is earlier; equal ends are a whole day."""
    return _length(interval.contains("-"), *_ends(interval))


def closes_late(interval: Column) -> Column:
    """Ends at 22:00 or later, or at 3:00 or earlier."""
    return _late(interval.contains("-"), _ends(interval)[1])


def open_days(text: Column) -> Column:
    """The days of an hours mapping that have a positive length: array of ``(day, minutes, late)``."""
    intervals = F.transform(F.map_entries(parse_mapping(text)), lambda e: F.struct(e["key"].alias("day"), _as_text(e["value"]).alias("i")))
    halves = F.transform(intervals, lambda d: F.struct(d["day"].alias("day"), d["i"].contains("-").alias("dash"), *[h.alias(n) for n, h in zip(("a", "b"), _halves(d["i"]))]))
    clocks = F.transform(halves, lambda d: F.struct(d["day"].alias("day"), d["dash"].alias("dash"), *[_clock(d[n]).alias(n) for n in ("a", "b")]))
    ends = F.transform(clocks, lambda d: F.struct(d["day"].alias("day"), d["dash"].alias("dash"), *[_minutes(d[n]).alias(n) for n in ("a", "b")]))
    days = F.transform(ends, lambda d: F.struct(d["day"].alias("day"), _length(d["dash"], d["a"], d["b"]).alias("minutes"), _late(d["dash"], d["b"]).alias("late")))
    kept = F.filter(days, lambda d: d["minutes"] > 0)
    return F.coalesce(kept, F.array().cast("array<struct<day:string,minutes:int,late:boolean>>"))


def opening_hours(days: str) -> dict[str, Column]:
    """Open days, weekly minutes, open weekend days and late closings, from a column made by ``open_days``."""
    return {
        "open_days_count": F.size(days).cast("double"),
        "weekly_open_minutes": F.aggregate(days, F.lit(0.0), lambda a, d: a + d["minutes"]),
        "weekend_days_open": F.size(F.filter(days, lambda d: d["day"].isin("Saturday", "Sunday"))).cast("double"),
        "late_night_days": F.size(F.filter(days, lambda d: d["late"])).cast("double"),
    }


def slug(text: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(cleaned != "", cleaned).otherwise("unknown")


def first_allowed(values: Column, allowed: list[str], other: str = "__other__") -> Column:
    """The first token that is in ``allowed``."""
    kept = F.filter(values, lambda t: F.trim(t).isin(allowed)) if allowed else F.array().cast("array<string>")
    return F.coalesce(F.trim(F.try_element_at(kept, F.lit(1))), F.lit(other))


def macro_category(values: Column, priority: list[str] = MACRO_CATEGORIES) -> Column:
    """The first category of the priority list that occurs, else the first token, else Other."""
    hits = F.filter(F.array(*[F.lit(p) for p in priority]), lambda p: F.array_contains(values, p))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.try_element_at(values, F.lit(1)), F.lit("Other"))
