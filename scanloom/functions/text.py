"""Column helpers over paths, lines and case-folded text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanloom.functions.dialect import CASE_TWINS, SPACE



def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/]*)\z", 1)


def extension(path: Column) -> Column:
    """Last suffix, lower-cased, with its dot; a name that only starts with dots has none."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)[^.].*(\.[^.]*)\z", 1))


def lines_of(content: Column) -> Column:
    return F.split(content, "\n", -1)


def fold_case(text: Column) -> Column:
    """Lower case in which an ASCII text is found wherever a case-blind regex would find it."""
    rare = reduce(or_, [F.contains(text, F.lit(c)) for c in CASE_TWINS])
    plain = F.translate(text, "".join(CASE_TWINS), "".join(CASE_TWINS.values()))
    return F.lower(F.when(rare, plain).otherwise(text))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def newline_normalized(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def one_json_value(text: Column, schema: str, mode: str = "PERMISSIVE") -> Column:
    """The text as one JSON object; null (or an error) where it is none, or where anything follows it.

    Spark stops reading after the first value, so the text is read as the only entry of a list.
    """
    values = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<struct<{schema}>>",
                         {"mode": mode, "allowSingleQuotes": "false"})
    return F.when(F.size(values) == 1, values[0])


def literal_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for entry in table.items() for x in entry])
