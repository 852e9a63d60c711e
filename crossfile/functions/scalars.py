"""Scalar expressions the checks share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short(sid: Column) -> Column:
    """module:Class.method -> Class.method"""
    return F.split_part(sid, F.lit(":"), F.lit(2))


def last_name(sid: Column) -> Column:
    """The last name of a symbol or dotted name."""
    return F.element_at(F.split(F.element_at(F.split(sid, ":"), -1), r"\."), -1)


def is_dunder(name: Column) -> Column:
    return name.startswith("__")


def folder(module: Column) -> Column:
    """The first dotted segment, or '' for a module at the top."""
    return F.when(F.instr(module, ".") > 0, F.split_part(module, F.lit("."), F.lit(1))).otherwise(F.lit(""))


def glob_regex(glob: str) -> str:
    """A shell pattern as a regular expression for rlike; * and ? cross /."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i:end].replace("\\", "\\\\").replace("[", "\\[")
            out.append(f"[^{body[1:]}]" if body.startswith("!") else f"[{body}]")
            i = end + 1
        else:
            out.append(c if c.isalnum() or c in "_/" else "\\" + c)
    return f"(?s)^{''.join(out)}$"


def given(call: Column, param: Column, positional: Column) -> Column:
    """The argument a call gives a parameter: by keyword, else by place, else null."""
    by_name = F.get(F.filter(call["keywords"], lambda k: k["k"] == param), F.lit(0))["arg"]
    place = F.array_position(positional, param)
    by_place = F.when(place > 0, F.get(call["args"], (place - 1).cast("int")))
    return F.coalesce(by_name, by_place)


def half_even(value: Column) -> Column:
    """Rounding as the score needs it: ties go to the even number."""
    return F.bround(value, 0).cast("int")


def rate(n: Column, of: Column, zero_at: float) -> Column:
    """100 for none, falling linearly to 0 at a share of ``zero_at``; 100 if there is nothing to count."""
    return F.when(of <= 0, F.lit(100)).otherwise(half_even(100 * F.greatest(F.lit(0.0), 1 - n / of / zero_at)))
