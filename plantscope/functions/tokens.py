"""Spreadsheet dirt: pseudo-missing words, number text, yes/no marks.

All are pure column expressions, so they work on batch and streaming frames.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whole-cell words read as missing, in any case.
NULL_WORDS = [
    "#NODATA", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NULL!",
    "N/A", "NA", "NaN", "None", "NULL", "—", "-", "--",
]

# Exact cell texts read as missing while a CSV file is parsed.
PARSE_WORDS = [
    "", " ", "#NODATA", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NULL!",
    "N/A", "NA", "NaN", "nan", "None", "NULL", "-", "--", "—", " - ",
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "n/a", "null",
]

# Stages of missingness, most ordinary first.
STAGE_WORDS = {
    1: ["", "none", "null", "nan", "na", "n/a", "-", "--", "_", "—"],
    2: ["#div/0!", "#n/a", "#ref!", "#value!", "#nodata"],
    3: ["#null!", "#name?", "#num!", "#spill!", "#calc!", "#busy!", "#unknown!"],
}

# Marks that make a column boolean, and the digit each stands for.
BOOLEAN_MARKS = {"": "0", "0": "0", "-": "0", "X": "0", "1": "1", "O": "1"}

_SPACE = r"[\s\x1c-\x1f]"
_PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_SIGNED_DECIMAL = r"^-?(\d+\.?\d*|\.\d+)$"


def unicode_trim(col: Column) -> Column:
    """Trim every Unicode space, not only the ASCII blank."""
    left = F.regexp_replace(col.cast("string"), f"(?U)^{_SPACE}+", "")
    return F.regexp_replace(left, f"(?U){_SPACE}+$", "")


def _whole_word(words: list[str]) -> str:
    return "(?i)^(" + "|".join(re.escape(w) for w in words) + ")$"


def null_tokens(col: Column) -> Column:
    """Trimmed text, NULL where the cell is empty or a null word."""
    text = unicode_trim(col)
    return F.when((text != "") & ~text.rlike(_whole_word(NULL_WORDS)), text)


def parse_nulls(col: Column) -> Column:
    """NULL where the raw cell, after its leading blanks, is one of the parser's missing words."""
    text = F.regexp_replace(col, "^ +", "")
    return F.when(~text.isin(PARSE_WORDS), text)


def missing_stage(col: Column) -> Column:
    """1 ordinary blank or null word, 2 common error word, 3 rarer error word, 0 a value.

    A NULL cell is stage 1.
    """
    text = F.lower(unicode_trim(col))
    out = F.when(text.isNull(), 1)
    for stage, words in STAGE_WORDS.items():
        out = out.when(text.isin(words), stage)
    return out.otherwise(0)


def plain_text(col: Column) -> Column:
    """Number text without comma marks and with a plain minus; NULL for other text."""
    text = F.translate(unicode_trim(col), "−,", "-")
    return F.when(text.rlike(_PLAIN_NUMBER), text)


def to_number(col: Column) -> Column:
    """Number text to double: comma marks dropped, U+2212 read as minus, anything else NULL."""
    return plain_text(col).try_cast("double")


def to_number_lenient(col: Column) -> Column:
    """Like :func:`to_number`, but other characters are dropped and several dots are thousands marks."""
    text = F.translate(unicode_trim(col), ",  ", "")
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    text = F.when(dots > 1, F.replace(text, F.lit("."), F.lit(""))).otherwise(text)
    text = F.regexp_replace(text, r"[^0-9.\-]", "")
    return F.when(text.rlike(_SIGNED_DECIMAL), text).try_cast("double")


def boolean_mark(col: Column, numeric: bool = False) -> Column:
    """Upper-case mark used by the boolean test; 0.0 and 1.0 count as 0 and 1."""
    if numeric:
        value = col.cast("double")
        return F.when(value == 0, "0").when(value == 1, "1").otherwise(col.cast("string"))
    return F.upper(unicode_trim(col.cast("string")))


def boolean_digit(mark: Column) -> Column:
    out = F.when(mark.isNull(), F.lit(None).cast("string"))
    for text, digit in BOOLEAN_MARKS.items():
        out = out.when(mark == text, digit)
    return out


def is_boolean_mark(mark: Column) -> Column:
    return mark.isin(list(BOOLEAN_MARKS))
