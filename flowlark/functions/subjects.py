"""Subjects and subject patterns.

A subject is tokens joined by dots.  In a pattern ``*`` stands for one token
and a last ``>`` for one or more.  Functions named ``*_regex`` take a pattern
known when the plan is built; the others compare two columns token by token.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_NAME, MAX_SUBJECT

NAME = rf"^[A-Za-z0-9_-]{{1,{MAX_NAME}}}$"
_TOKEN = r"(?:[A-Za-z0-9_-]+|\*)"
SUBJECT = rf"^(?=.{{1,{MAX_SUBJECT}}}$)(?:{_TOKEN}\.)*(?:{_TOKEN}|>)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def escape(text: str) -> str:
    """A literal for both Java's and RE2's syntax."""
    return "".join(c if c.isalnum() or c in "_-" else "\\" + c for c in text)


def pattern_regex(pattern: str) -> str:
    """The regular expression of a pattern.

    Subjects that were never validated may end in dots: up to two are looked
    through, as the token walk ends there.
    """
    parts = []
    for token in pattern.split("."):
        if token == ">":
            return "^" + "".join(p + r"\." for p in parts) + "[^.].*$"
        parts.append("[^.]+" if token == "*" else escape(token))
    return "^" + r"\.".join(parts) + r"\.{0,2}$"


def subject_matches(subject: Column | str, pattern: str) -> Column:
    """Whether a subject matches a known pattern; plain equality reaches the scan where there is no wildcard."""
    subject = _col(subject)
    if pattern == ">":
        return ~subject.startswith(".") & (subject != "")
    if "*" not in pattern and not pattern.endswith(">"):
        return subject.isin(pattern, pattern + ".", pattern + "..")
    head = pattern.split("*")[0].split(">")[0]
    found = subject.rlike(pattern_regex(pattern))
    return (subject.startswith(head) & found) if head else found


def tokens(c: Column | str) -> Column:
    """The tokens of a subject or pattern."""
    return F.split(_col(c), r"\.")


def next_token(c: Column | str) -> Column:
    """The first token."""
    return F.substring_index(_col(c), ".", 1)


def rest(c: Column | str) -> Column:
    """What follows the first dot; empty without one."""
    c = _col(c)
    return F.when(F.instr(c, ".") > 0, F.regexp_replace(c, r"^[^.]*\.", "")).otherwise("")


def is_literal(pattern: Column | str) -> Column:
    """Whether a pattern has no wildcard."""
    return ~_col(pattern).rlike(r"(^|\.)[*>](\.|$)")


def filter_kind(pattern: Column | str) -> Column:
    """catch_all, exact or pattern."""
    p = _col(pattern)
    return F.when(p.isNull() | (p == ""), "catch_all").when(is_literal(p), "exact").otherwise("pattern")


def _prefix_fits(a: Column, b: Column, n: Column, fits: object) -> Column:
    """Whether the first n tokens of both fit, pair by pair."""
    return F.forall(
        F.zip_with(F.slice(a, 1, F.greatest(n, F.lit(0))), F.slice(b, 1, F.greatest(n, F.lit(0))), fits), lambda x: x
    )


def matches(pattern: Column | str, subject: Column | str) -> Column:
    """Whether validated subjects match patterns, of two columns."""
    p, s = tokens(pattern), tokens(subject)
    open_ = F.element_at(p, -1) == ">"
    fits = lambda x, y: (x == y) | (x == "*")
    return F.when(open_, (F.size(s) >= F.size(p)) & _prefix_fits(p, s, F.size(p) - 1, fits)).otherwise(
        (F.size(s) == F.size(p)) & _prefix_fits(p, s, F.size(p), fits)
    )


def covers(wide: Column | str, narrow: Column | str) -> Column:
    """Whether every subject of ``narrow`` matches ``wide``; ``*`` never covers ``>``."""
    w, n = tokens(wide), tokens(narrow)
    open_ = F.element_at(w, -1) == ">"
    fits = lambda x, y: (y != ">") & ((x == y) | (x == "*"))
    return F.when(open_, (F.size(n) >= F.size(w)) & _prefix_fits(w, n, F.size(w) - 1, fits)).otherwise(
        (F.size(n) == F.size(w)) & _prefix_fits(w, n, F.size(w), fits)
    )


def overlaps(a: Column | str, b: Column | str) -> Column:
    """Whether some subject matches both."""
    x, y = tokens(a), tokens(b)
    until = lambda t: F.when(F.element_at(t, -1) == ">", F.size(t) - 1).otherwise(F.lit(1 << 20))
    stop = F.least(until(x), until(y))
    fits = lambda p, q: (p == q) | (p == "*") | (q == "*")
    shorter = F.least(F.size(x), F.size(y))
    return F.when(stop < (1 << 20), (shorter > stop) & _prefix_fits(x, y, stop, fits)).otherwise(
        (F.size(x) == F.size(y)) & _prefix_fits(x, y, F.size(x), fits)
    )


def strictly_nested(narrow: Column | str, wide: Column | str) -> Column:
    """Covered, but not equal as a set."""
    return covers(wide, narrow) & ~covers(narrow, wide)


def valid_name(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(NAME), F.lit(False))


def valid_subject(c: Column | str) -> Column:
    """Whether a subject or pattern obeys the grammar."""
    return F.coalesce(_col(c).rlike(SUBJECT), F.lit(False))


def name_error(c: Column | str) -> Column:
    """Null, or why a name is refused: empty, too_long, invalid_char."""
    c = _col(c)
    return (
        F.when(c.isNull() | (c == ""), "empty")
        .when(F.octet_length(c) > MAX_NAME, "too_long")
        .when(~c.rlike(NAME), "invalid_char")
    )


def subject_error(c: Column | str) -> Column:
    """Null, or why a subject is refused: empty, too_long, invalid_char."""
    c = _col(c)
    return (
        F.when(c.isNull() | (c == ""), "empty")
        .when(F.octet_length(c) > MAX_SUBJECT, "too_long")
        .when(~c.rlike(SUBJECT), "invalid_char")
    )


def slug(c: Column | str) -> Column:
    """A token made of any text."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-"), F.lit("-"))


def service_method(subject: Column | str, service: str) -> Column:
    """The method that a request to a service names; null for other subjects."""
    found = F.regexp_extract(_col(subject), rf"^_svc\.{escape(service)}\.m\.(.+)$", 1)
    return F.nullif(found, F.lit(""))
