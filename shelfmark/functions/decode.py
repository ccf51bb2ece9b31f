"""Character decoding that has no built-in column function: one Arrow pass each.

All take null texts as empty ones.  Apply them to distinct values where rows repeat
(codes); page texts are distinct anyway.
"""

from __future__ import annotations

import html
import re
import unicodedata
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from shelfmark.functions.text import text


@F.pandas_udf(StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape)


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z0-9]+);")


def _whole(m: re.Match[str]) -> str:
    return html.unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0])


@F.pandas_udf(StringType())
def _unescape_closed(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _CLOSED.sub(_whole, x))


@F.pandas_udf(ArrayType(StringType()))
def _unescape_all(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: None if xs is None else [html.unescape(x) for x in xs])


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x))


def unescape(c: Column, closed: bool = False) -> Column:
    """Named entities of HTML5 (the longest known name, with or without semicolon) and numeric ones as characters; others stay.

    ``closed``: only those that a semicolon ends; what a cut has left of one stays.
    """
    return (_unescape_closed if closed else _unescape)(text(c))


def unescape_all(c: Column) -> Column:
    """``unescape`` of each text of an array, for use where a lambda function would have to call it (Python cannot run inside one)."""
    return _unescape_all(F.transform(c, text))


def compatible(c: Column) -> Column:
    """Compatibility normal form (NFKC): full-width letters, circled digits, squared units as plain ones."""
    return _nfkc(text(c))
