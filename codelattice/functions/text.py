"""Column functions for names, paths and terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_part(id_: Column) -> Column:
    """The file of an id: what stands before the first ``::``."""
    return F.substring_index(id_, "::", 1)


def folder_of(path: Column) -> Column:
    """The folder of a path: '.' for a bare name, '/' for a name in the root."""
    p = F.regexp_replace(F.coalesce(path, F.lit("")), "/+$", "")
    cut = F.regexp_replace(p, "/[^/]*$", "")
    return F.when(~p.contains("/"), F.lit(".")).when(cut == "", F.lit("/")).otherwise(cut)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_of(path: Column) -> Column:
    """The last extension with its dot; '' without one and for dot files."""
    return F.regexp_extract(base_name(F.coalesce(path, F.lit(""))), r"^.+(\.[^.]*)$", 1)


def last_name(name: Column) -> Column:
    """The last segment after dots, then after double colons; the whole where a segment is empty."""
    dots = F.element_at(F.split(name, r"\."), -1)
    after = F.when(name.contains(".") & (dots != ""), dots).otherwise(name)
    colons = F.element_at(F.split(after, "::"), -1)
    return F.when(after.contains("::") & (colons != ""), colons).otherwise(after)


def terms_of(question: str) -> list[str]:
    """Lower-case terms of more than two characters; repeated terms stay."""
    out = [t.translate(str.maketrans("", "", "?,.:;!")).lower().strip() for t in question.split()]
    return [t for t in out if len(t) > 2]


def fixed1(x: float) -> str:
    """One decimal, the exact binary value rounded half up."""
    from decimal import ROUND_HALF_UP, Decimal

    return str(Decimal(x).quantize(Decimal("0.1"), ROUND_HALF_UP))


def without_ansi(c: Column) -> Column:
    """Text without the control sequences of terminals."""
    return F.regexp_replace(c, r"[\u001b\u009b][\[()#;?]*(?:[0-9]{1,4}(?:;[0-9]{0,4})*)?[0-9A-ORZcf-nqry=><]", "")


def html_escaped(c: Column) -> Column:
    """Text that can stand in HTML: ampersand, angle brackets and both quotes as entities."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def in_locale_order(c: Column) -> Column:
    """A sort key for the order of dictionaries instead of code points: case and accents decide last."""
    return F.collate(c, "UNICODE")


def hundredths(c: Column) -> Column:
    """Two decimals, half up."""
    return F.floor(c * 100 + 0.5) / 100
