"""HTML to plain text: the one function that built-in expressions can't say exactly. Each pass reads a text once, whatever is in it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Named references that are decoded; a no-break space becomes a plain one.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–", "hellip": "…", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“"}
PASSES = 5
_REFERENCE = re.compile(r"&([^;&]{0,9});")
_SILENT = [(re.compile(rf"<{t}(?=[>\s/])", re.I | re.A), re.compile(f"</{t}>", re.I | re.A)) for t in ("script", "style")]
_TAG = re.compile(r"<[^>]*>")
_BLANK = re.compile(r"[ \t\n\r\f\v]+")


def _decoded(m: re.Match) -> str:
    name = m[1]
    if name in NAMED:
        return NAMED[name]
    number = re.fullmatch(r"#(?:[xX]([0-9a-fA-F]+)|([0-9]+))", name)
    if not number:
        return m[0]
    n = int(number[1], 16) if number[1] else int(number[2])
    if n > 0x10FFFF:
        return m[0]
    if n < 32 and n not in (9, 10, 13) or 127 <= n <= 159:
        return ""
    return "�" if 0xD800 <= n <= 0xDFFF else chr(n)


def without(s: str, begins: re.Pattern, ends: re.Pattern) -> str:
    """The text without what stands from a beginning to the next end. Where no end follows, none does for later beginnings either."""
    kept, at = [], 0
    while (b := begins.search(s, at)) and (e := ends.search(s, b.end())):
        kept.append(s[at : b.start()])
        at = e.end()
    return "".join([*kept, s[at:]]) if kept else s


def without_tags(s: str) -> str:
    """The text without its tags. Up to the last '>' each '<' has its end, so the search never runs on in vain."""
    last = s.rfind(">") + 1
    return _TAG.sub("", s[:last]) + s[last:] if last else s


def plain_text(s: str | None) -> str | None:
    """Decodes, drops script and style, strips tags until nothing changes (five passes at most), then single blanks.

    A '<' that nothing closes is text; unknown references stay as they are.
    """
    if s is None:
        return None
    for _ in range(PASSES):
        before = s
        s = _REFERENCE.sub(_decoded, s)
        for begins, ends in _SILENT:
            s = without(s, begins, ends)
        s = without_tags(s)
        if s == before:
            break
    return _BLANK.sub(" ", _REFERENCE.sub(_decoded, s)).strip(" ")


@F.pandas_udf(StringType())
def _marked_up(html: pd.Series) -> pd.Series:
    return html.map(plain_text, na_action="ignore")


def html_to_text(html: str | Column) -> Column:
    """``plain_text`` of a column; texts without a tag or a reference never leave the JVM."""
    html = F.col(html) if isinstance(html, str) else html
    marked = html.contains("<") | html.contains("&")
    return F.coalesce(_marked_up(F.when(marked, html)), F.when(~marked, F.trim(F.regexp_replace(html, r"[ \t\n\r\f\x0B]+", " "))))
