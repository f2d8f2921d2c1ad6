"""Scalar text rules: normalisation, bounded text, messages, classifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The characters that str.strip() takes off.
PY_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000")


def blank_to_null(c) -> Column:
    """str(v).strip() or None: strip, then an empty text becomes null."""
    t = py_strip(col_(c).cast("string"))
    return F.when(t == "", F.lit(None).cast("string")).otherwise(t)


def first_nonblank(*cols) -> Column:
    """Python ``a or b or c`` over texts: the first non-empty value."""
    return F.coalesce(*[F.nullif(col_(c).cast("string"), F.lit("")) for c in cols])


def py_strip(c) -> Column:
    """``str.strip()``: leading and trailing whitespace, not just spaces."""
    return F.btrim(col_(c), F.lit(PY_SPACE))


def py_lstrip(c) -> Column:
    """``str.lstrip()``."""
    return F.ltrim(col_(c), F.lit(PY_SPACE))
