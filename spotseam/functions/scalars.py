"""Scalar functions: numbers, times, names, switches. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    """A literal for a plain value; columns stay."""
    return x if isinstance(x, Column) else F.lit(x)


def number(text: Column) -> Column:
    """A double, 0 where the text is none."""
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0))


def rounded(value: Column, places: int) -> Column:
    """A double scaled, rounded half away from zero and scaled back, as SQL's ``round`` does.

    ``F.round`` goes by the shortest decimal text instead: near a tie the two disagree.
    """
    y = value * float(10**places)
    size = F.abs(y)
    whole = F.floor(size)
    return F.when(size < 2.0**52, F.signum(y) * (whole + F.when(size - whole >= 0.5, 1).otherwise(0)) / float(10**places)).otherwise(value)


def fraction(text: Column) -> Column:
    """``a/b`` as a double, a plain number as it is, 0 where neither; a zero denominator gives 0."""
    a, b = F.split_part(text, F.lit("/"), F.lit(1)), F.split_part(text, F.lit("/"), F.lit(2))
    ratio = F.when(F.length(F.regexp_replace(text, "[^/]", "")) == 1, F.try_divide(F.trim(a).try_cast("double"), F.trim(b).try_cast("double")))
    return F.coalesce(ratio, number(text))


def switch(text: Column, default=False) -> Column:
    """true/yes/1/on and false/no/0/off in any case; the default for anything else."""
    t = F.lower(F.trim(text))
    return F.when(t.isin("true", "yes", "1", "on"), True).when(t.isin("false", "no", "0", "off"), False).otherwise(col(default))


def choice(text: Column, values: list[str], default: str) -> Column:
    """The value whose letters are the text's, underscores and case aside."""
    t, out = F.lower(F.replace(F.trim(text), F.lit("_"))), F.lit(default)
    for v in values:
        out = F.when(t == v.lower().replace("_", ""), F.lit(v)).otherwise(out)
    return out


def items(text: Column) -> Column:
    """Comma-separated items, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def frame(us: Column, fps: Column) -> Column:
    """The frame at a time, cut off toward zero."""
    return (us / 1e6 * fps).cast("bigint")


def padded(n: Column, width: int) -> Column:
    text = n.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def seconds3(us: Column) -> Column:
    """Seconds with three decimals, half up, from whole microseconds (never negative here)."""
    ms = F.floor((us + 500) / 1000)
    return F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), padded(ms % 1000, 3))


def clock(us: Column, tail: str = "") -> Column:
    """``HH:MM:SS.mmm`` and a tail; milliseconds cut off."""
    ms = F.floor(us / 1000)
    return F.concat(padded(F.floor(ms / 3600000), 2), F.lit(":"), padded(F.floor(ms / 60000) % 60, 2), F.lit(":"), padded(F.floor(ms / 1000) % 60, 2), F.lit("."), padded(ms % 1000, 3), F.lit(tail))


def mkv_time(us: Column) -> Column:
    return clock(us, "000000")


def report_time(s: Column) -> Column:
    """``M:SS`` or ``H:MM:SS``, fractions cut off."""
    t = F.floor(s).cast("bigint")
    h, m, sec = F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), padded(m, 2), F.lit(":"), padded(sec, 2))).otherwise(F.concat(m.cast("string"), F.lit(":"), padded(sec, 2)))


def span_text(us: Column) -> Column:
    """``[d.]hh:mm:ss[.fffffff]``, the default text of a duration."""
    s, rest = F.floor(us / 1000000), us % 1000000
    days = F.floor(s / 86400)
    return F.concat(F.when(days > 0, F.concat(days.cast("string"), F.lit("."))).otherwise(""), padded(F.floor(s / 3600) % 24, 2), F.lit(":"), padded(F.floor(s / 60) % 60, 2), F.lit(":"), padded(s % 60, 2), F.when(rest > 0, F.concat(F.lit("."), padded(rest, 6), F.lit("0"))).otherwise(""))


def basename(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*[/\\]", "")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"(\.[^.]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def with_extension(path: Column, ext) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), col(ext))


def safe_name(name: Column) -> Column:
    """Characters that file names can't hold become underscores."""
    return F.regexp_replace(name, r'[\x00-\x1f"<>|:*?\\/]', "_")


def glob_regex(pattern: str) -> str:
    """``*`` and ``?`` as a case-insensitive expression over the whole name."""
    special = set(".^$+{}[]()|\\")
    return "(?i)^" + "".join({"*": ".*", "?": "."}.get(c, "\\" + c if c in special else c) for c in pattern) + "$"


def filled(template, **values) -> Column:
    """A template with its ``{name}`` places filled, one after another."""
    out = col(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), col(v).cast("string"))
    return out


def csv_quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
