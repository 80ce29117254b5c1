"""Text rules of the marketplace as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns.
WHITE_SPACE = r"[\s\p{Z}\x1C-\x1F]"
ID_SHAPE = r"[0-9a-fA-F-]{36}"
ISO_DATE_SHAPE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
INTEGER_SHAPE = r"[+-]?[0-9]+"
NUMBER_SHAPE = r"([+-]?)(NaN|Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[fFdD]?"
# What surrounds a decimal and is passed over: all characters up to the blank.
DECIMAL_MARGIN = r"[\x00-\x20]*"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sanitize(c) -> Column:
    """Upper-case and keep only A-Z and underscore."""
    return F.regexp_replace(F.upper(_col(c)), "[^A-Z_]", "")


def trim_ws(c) -> Column:
    """Strip Unicode white space at both ends (SQL ``trim`` strips spaces only)."""
    return F.regexp_replace(_col(c), f"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")


def is_blank(c) -> Column:
    return trim_ws(c) == ""


def utf16_length(c) -> Column:
    """Length in UTF-16 code units: characters beyond the BMP count twice."""
    return (F.octet_length(F.encode(_col(c), "UTF-16BE")) / 2).cast("int")


def full_match(c, pattern: str) -> Column:
    """Whole-string match; ``$`` alone would let a trailing newline through."""
    return _col(c).rlike(rf"\A(?:{pattern})\z")


def valid_id_shape(c) -> Column:
    return full_match(c, ID_SHAPE)


def file_ext(c) -> Column:
    """Lower-cased text after the last dot, empty when there is none."""
    return F.lower(F.regexp_extract(_col(c), r"\.([^.]*)\z", 1))


def default_phone(phone, uid) -> Column:
    return F.coalesce(_col(phone), F.concat(F.lit("email:"), _col(uid)))


def int_or_null(c) -> Column:
    """Whole text as an integer, NULL when it is anything else (no trimming)."""
    return F.when(full_match(c, INTEGER_SHAPE), _col(c).try_cast("int"))


def double_or_null(c) -> Column:
    """A decimal as the reading language takes it: blanks around it, a type letter behind
    it, NaN and Infinity are allowed; NULL for anything else. Hexadecimal floats are not
    read and give NULL."""
    whole = rf"\A{DECIMAL_MARGIN}{NUMBER_SHAPE}{DECIMAL_MARGIN}\z"
    sign, digits = (F.regexp_extract(_col(c), whole, k) for k in (1, 2))
    return F.when(_col(c).rlike(whole), F.concat(sign, digits).try_cast("double"))
