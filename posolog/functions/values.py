"""Scalar expressions: numbers, dates, drug names, routes, errors, buckets."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posolog.functions import fixed_values as V

_NUMERIC_TEXT = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


#: White space of ASCII that ``squish`` rewrites.
_SPACES = ("  ", "\t", "\n", "\x0b", "\f", "\r")


def words(pattern: str) -> str:
    """Make ``\\b``, ``\\w`` and ``\\s`` follow Unicode on every Java version."""
    return "(?U)" + pattern if any(c in pattern for c in (r"\b", r"\w", r"\s")) else pattern


def _alternatives(pattern: str) -> list[str]:
    """Parts of ``a|b(c|d)|e`` at the outermost level."""
    parts, depth = [""], 0
    for c in pattern:
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "|" and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def _opening_text(alternative: str) -> str:
    """Plain text every match of one alternative must contain (may be empty)."""
    found = re.match(r"(?:\\b)?([a-z0-9 -]+)([?*{]?)", alternative)
    if not found:
        return ""
    return found[1][:-1] if found[2] else found[1]


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    first, *rest = dict.fromkeys(parts)
    found = text.contains(first)
    for part in rest:
        found = found | text.contains(part)
    return found


def _sooner(pattern: str) -> str:
    """The same matches, with what they open with looked up before any word boundary."""
    opening = _opening_text(pattern)
    if pattern.startswith(r"\b") and opening:
        return f"(?={re.escape(opening)}){pattern}"
    return r"(?=\d)" + pattern if pattern.startswith(r"(?<!\()\b(\d") else pattern


def matches(text: Column, pattern: str, *hints: str) -> Column:
    """``text.rlike(pattern)``, cheaper.

    Plain alternatives become ``contains``.  The others run as regular expressions,
    each only on texts that hold the text it opens with (or all as one on texts with
    one of ``hints``, which the caller guarantees to be part of every match).
    """
    plain = [a for a in _alternatives(pattern) if re.fullmatch(r"[a-z0-9 -]+", a)]
    others: dict[str, list[str]] = {}
    for a in _alternatives(pattern):
        if a not in plain:
            others.setdefault("" if hints else _opening_text(a), []).append(_sooner(a))
    found = contains_any(text, plain) if plain else None
    for opening, patterns in others.items():
        regex = text.rlike(words("|".join(patterns)))
        needed = list(hints) or [opening]
        if all(needed):
            regex = contains_any(text, needed) & regex
        found = regex if found is None else found | regex
    return found


def squish(text: Column, source: Column | None = None) -> Column:
    """Trim and collapse every run of white space to one blank.

    Only runs and characters that change are matched, so ordinary text is read
    once and not rewritten; ASCII text without any runs through no regular expression.
    ``source`` is the text before a change of case, if it is cheaper to read.
    """
    seen = text if source is None else source
    ordinary = (F.octet_length(seen) == F.char_length(seen)) & ~contains_any(seen, _SPACES)
    return F.trim(F.when(ordinary, text).otherwise(F.regexp_replace(text, r"(?U)\s{2,}|[\s&&[^ ]]", " ")))


def evaluated(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed exactly once per row.

    The optimizer may copy a projected expression into every filter above it.
    The output of a one-element ``inline`` is not copied, which matters for
    expensive text rules that a filter follows.  Existing columns of the same
    name are replaced.
    """
    fields = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(fields)))


def text_number(text: Column) -> Column:
    """Text to double; anything that is not a plain number becomes NULL."""
    return F.when(text.rlike(_NUMERIC_TEXT), F.trim(text).try_cast("double"))


def number(df: DataFrame, name: str | None) -> Column:
    """A numeric column of ``df`` as double; absent, unreadable and NaN are NULL."""
    if name is None or name not in df.columns:
        return F.lit(None).cast("double")
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return text_number(F.col(name))
    as_double = F.col(name).cast("double")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.nanvl(as_double, F.lit(None).cast("double"))
    return as_double


def day(df: DataFrame, name: str | None) -> Column:
    """A date column of ``df``; text is read in the accepted formats, else NULL."""
    if name is None or name not in df.columns:
        return F.lit(None).cast("date")
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.coalesce(
            *[F.try_to_date(F.trim(F.col(name)), f) for f in V.DATE_FORMATS]
        )
    return F.col(name).cast("date")


def matched_number(text: Column, pattern: str, *hints: str) -> Column:
    """First number inside the first match of ``pattern``; NULL without a match.

    ``hints`` are texts of which every match contains at least one.
    """
    value = first_number(F.regexp_extract(text, words(_sooner(pattern)), 0))
    return F.when(contains_any(text, hints), value) if hints else value


def first_number(text: Column, pattern: str = V.NUMBER) -> Column:
    """The first match of ``pattern`` as double; NULL without one.

    An empty text is not cast: that throws and catches an exception for the row.
    """
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(0)).try_cast("double")


def mg_in_name(text: Column) -> Column:
    """Strength named in a drug text, such as 10 in ``PREDNISONE 10 MG TABLET``."""
    return matched_number(F.lower(text), V.MG_IN_NAME)


def standard_drug_name(
    text: Column, overrides: Sequence[tuple[str, str]] | None = None
) -> Column:
    """Canonical steroid name, or the cleaned text when no rule matches.

    ``text`` is read many times; ``with_drug_name`` cleans it once beforehand.
    ``overrides`` are ``(pattern, canonical name)`` pairs.  They win over the
    built-in rules, match without regard to case, and the last one wins.
    """
    return canonical_name(clean_name(text), overrides)


def clean_name(text: Column) -> Column:
    return squish(F.lower(text.cast("string")), text.cast("string"))


def canonical_name(
    clean: Column, overrides: Sequence[tuple[str, str]] | None = None
) -> Column:
    """Standard name of an already cleaned drug text."""
    name = F.when(
        matches(clean, V.PREDNISOLONE_WORD) & ~clean.contains(V.METHYL_WORD),
        F.lit("prednisolone"),
    )
    for pattern, canonical in V.DRUG_NAME_PATTERNS:
        name = name.when(matches(clean, pattern), F.lit(canonical))
    name = name.otherwise(clean)
    if not overrides:
        return name
    last_first = list(overrides)[::-1]
    picked = F.when(clean.rlike("(?i)" + last_first[0][0]), F.lit(last_first[0][1]))
    for pattern, canonical in last_first[1:]:
        picked = picked.when(clean.rlike("(?i)" + pattern), F.lit(canonical))
    return picked.otherwise(name)


def route_text(*texts: Column) -> Column:
    """First non-NULL text in lower case (an empty text counts as present)."""
    return F.coalesce(*[F.lower(t.cast("string")) for t in texts], F.lit(""))


def route_class(route: Column) -> Column:
    """Route class of a lower-case route text."""
    (name, pattern), *rest = V.ROUTE_PATTERNS
    klass = F.when(matches(route, pattern), F.lit(name))
    for name, pattern in rest:
        klass = klass.when(matches(route, pattern), F.lit(name))
    return klass.otherwise(F.lit("other"))


def inclusive_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def positive_days(start: Column, end: Column) -> Column:
    """Inclusive day count; NULL when the end lies before the start."""
    days = inclusive_days(start, end)
    return F.when(days > 0, days.cast("double"))


def not_before(start: Column, end: Column) -> Column:
    """The end date, or the start where the end is absent or earlier."""
    return F.when(end.isNull() | (end < start), start).otherwise(end)


def overlap_days(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared days of two closed intervals; NULL when any bound is NULL."""
    complete = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()
    shared = F.datediff(F.least(e1, e2), F.greatest(s1, s2)) + 1
    return F.when(complete, F.greatest(shared, F.lit(0)))


def age_at(index_date: Column, year_of_birth: Column) -> Column:
    return F.year(index_date) - year_of_birth


def bucket(value: Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed interval holding ``value``; NULL outside all."""
    if len(breaks) != len(labels) + 1:
        raise ValueError(
            "breaks must have exactly one more element than labels: "
            f"got {len(breaks)} breaks and {len(labels)} labels"
        )
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(breaks[:-1], breaks[1:], labels))):
        out = F.when((value > low) & (value <= high), F.lit(label)).otherwise(out)
    return out


def bucket_order(label: Column, labels: Sequence[str]) -> Column:
    """Sort key that keeps labels in their given order."""
    out = F.when(label == labels[0], F.lit(0))
    for i, name in enumerate(labels[1:], start=1):
        out = out.when(label == name, F.lit(i))
    return out.otherwise(F.lit(len(labels)))
