"""What diagnostics say, by code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXTS = {
    "cycle": "leads back into a directory on its own way",
    "unresolvable_link": "leads to nothing that is listed",
    "depth_exceeded": "lies deeper than the run goes",
    "path_too_long": "has a longer path than the run takes",
    "too_large": "has more bytes than the run takes",
    "unreadable": "has no content that could be read",
    "permission_denied": "may not be read",
    "disappeared": "is not there any more",
    "cannot_open": "could not be opened",
    "name_not_utf8": "has a name that is not UTF-8, shown with escapes",
}


def text(code: str, about: str) -> str:
    """The message for tasks in Python."""
    return f"{about} {TEXTS[code]}"


def said(code: str, about: Column) -> Column:
    """The same as a column named ``message``."""
    return F.concat(about, F.lit(f" {TEXTS[code]}")).alias("message")


def said_by_code(code: Column, about: Column) -> Column:
    """The same where the code is a column."""
    texts = F.create_map(*(F.lit(x) for pair in TEXTS.items() for x in pair))
    return F.concat(about, F.lit(" "), F.element_at(texts, code)).alias("message")
