"""Glob patterns as columns.

``*`` is any run of characters (dots included, empty allowed), ``?`` one
character, ``[..]``/``[!..]`` one character (not) of a class.  A ``[`` that is
never closed stands for itself, and a range whose ends are in reverse order is
empty.  Everything here runs over feed entries, never over log lines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- fixed values: how a glob is cut into parts ------------------------------
GLOB_PART = r"(?s)\[!?\]?[^\]]*\]|."
CLASS_PART = r"(?s).-.|."
NO_CHARACTER = r"[^\x{0}-\x{10FFFF}]"
GLOB_MARKS = r"[*?\[]"
HOLE = "\u0000"

_is_class = lambda part: F.length(part) > 1


def _parts(glob: Column) -> Column:
    return F.regexp_extract_all(glob, F.lit(GLOB_PART), F.lit(0))


def _escape(text: Column, specials: str) -> Column:
    return F.regexp_replace(text, specials, r"\\$1")


def _class_regex(part: Column) -> Column:
    negated = F.startswith(part, F.lit("[!"))
    skip = F.when(negated, F.lit(2)).otherwise(F.lit(1))
    body = part.substr(skip + 1, F.length(part) - skip - 1)

    def member(m: Column) -> Column:
        def one(c: Column) -> Column:
            return _escape(c, r"([\[\]^&~\\-])")

        low, high = m.substr(1, 1), m.substr(3, 1)
        span = F.when(low <= high, F.concat(one(low), F.lit("-"), one(high))).otherwise(F.lit(""))
        return F.when(F.length(m) == 3, span).otherwise(one(m))

    inner = F.array_join(
        F.transform(F.regexp_extract_all(body, F.lit(CLASS_PART), F.lit(0)), member), ""
    )
    return (
        F.when((inner == "") & negated, F.lit("."))
        .when(inner == "", F.lit(NO_CHARACTER))
        .when(negated, F.concat(F.lit("[^"), inner, F.lit("]")))
        .otherwise(F.concat(F.lit("["), inner, F.lit("]")))
    )


def glob_to_regex(glob: Column) -> Column:
    """Anchored Java regular expression equal in meaning to the glob."""

    def piece(part: Column) -> Column:
        return (
            F.when(part == "*", F.lit(".*"))
            .when(part == "?", F.lit("."))
            .when(_is_class(part), _class_regex(part))
            .otherwise(_escape(part, r"([.+^$(){}|\[\]\\])"))
        )

    body = F.array_join(F.transform(_parts(glob), piece), "")
    return F.concat(F.lit("(?s)^"), body, F.lit(r"\z"))


def glob_literals(glob: Column) -> Column:
    """The literal runs of a glob in order; first and last may be empty."""

    def literal(part: Column) -> Column:
        hole = (part == "*") | (part == "?") | _is_class(part)
        return F.when(hole, F.lit(HOLE)).otherwise(part)

    return F.split(F.array_join(F.transform(_parts(glob), literal), ""), HOLE, -1)


def suffix_key(glob: Column) -> Column:
    """``X`` for a glob that is exactly ``*.X`` with a literal ``X``, else null."""
    rest = glob.substr(F.lit(3), F.length(glob))
    return F.when(F.startswith(glob, F.lit("*.")) & (rest != "") & ~rest.rlike(GLOB_MARKS), rest)


def is_pieces(glob: Column) -> Column:
    """Whether a glob is made of literal pieces and ``*`` alone."""
    return ~F.contains(glob, F.lit("?")) & ~F.contains(glob, F.lit("["))


def pieces_match(text: Column, glob: Column) -> Column:
    """Whether a text matches a glob of pieces: its first and last one at the ends, the others between, in order.

    Each piece is looked for behind the one before, at its first place, so no expression is compiled for a pair.
    """
    parts = F.split(glob, r"\*", -1)
    first, last = F.get(parts, F.lit(0)), F.element_at(parts, -1)
    inner = F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), lambda p: p != "")

    def behind(at: Column, piece: Column) -> Column:
        found = F.call_function("locate", piece, text, at)
        return F.when((at > 0) & (found > 0), found + F.length(piece)).otherwise(F.lit(0))

    reached = F.aggregate(inner, F.length(first) + 1, behind)
    ends = F.startswith(text, first) & F.endswith(text, last)
    return F.when(F.size(parts) == 1, text == glob).otherwise(ends & (reached > 0) & (reached - 1 <= F.length(text) - F.length(last)))
