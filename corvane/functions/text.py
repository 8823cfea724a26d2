"""String column functions whose white space is that of Python's str methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 white-space code points that str.split and str.strip know.
WS = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+$", "")


def tokens(c: Column) -> Column:
    """The distinct white-space-separated tokens, as they stand."""
    return F.array_distinct(F.filter(F.split(c, f"{WS}+"), lambda x: x != ""))


def sentences(c: Column) -> Column:
    """Stripped non-blank parts between full stops."""
    return F.filter(F.transform(F.split(c, r"\."), strip), lambda s: s != "")


def ends_with_stop_word(c: Column, word: str = "TERMINATE") -> Column:
    """Whether the right-stripped text ends with ``word``; null is empty."""
    return F.endswith(rstrip(F.coalesce(c, F.lit(""))), F.lit(word))
