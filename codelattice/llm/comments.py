"""Text of documentation comments without the comment's own marks."""

from __future__ import annotations

import re

_OPEN = re.compile(r"^\s*(?:/\*+!?|\"{3}|'{3}|<!--)")
_CLOSE = re.compile(r"\s*(?:\*+/|\"{3}|'{3}|-->)\s*$")
_LINE = re.compile(r"^[ \t]*(?://[/!]?|\#(?![#!]))[ \t]?", re.M)
_STAR = re.compile(r"^[ \t]*\*(?!/)[ \t]?", re.M)


def strip_marks(doc: str) -> str:
    """Remove the marks of a raw comment; a text without them comes back unchanged.

    ``/* */`` and its leading stars, runs of ``//``, ``///`` or ``//!`` lines. A bare text is not
    searched for stars, as these may be bullets.
    """
    t = doc.strip("\n\r")
    head = t.lstrip()
    if head.startswith("/*"):
        t = _CLOSE.sub("", _OPEN.sub("", t, count=1))
        return _STAR.sub("", t).strip("\n\r ")
    if head.startswith("//"):
        lines = t.split("\n")
        if all(x.lstrip().startswith("//") or not x.strip() for x in lines):
            return _LINE.sub("", t).strip("\n\r")
    q = head[:3]
    if q == '"""' and t.rstrip().endswith(q) or q == "'''" and t.rstrip().endswith(q) and "\n" in t:  # short ones may be wiki's bold
        return _CLOSE.sub("", _OPEN.sub("", t, count=1)).strip("\n\r")
    return t
