"""Text cells: null tokens, typing, conversion, dates in names, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that stand for a missing value when entities are loaded.
ENTITY_NULL_TOKENS = ["", "n.a.", "null", "nil", "none", "n/a"]
# Texts skipped when the type of a column is inferred.
INFERENCE_NULL_TOKENS = ["", "null", "nil"]
# Texts accepted as booleans when the type of a column is inferred.
BOOLEAN_TOKENS = ["true", "false", "t", "f", "yes", "no", "y", "n", "1", "0"]

INTEGER = r"^[+-]?[0-9]+$"
FLOAT = (
    r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
    r"|^[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?)$|^[nN][aA][nN]$"
)
LETTERS = r"[A-Za-z_]"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
TIMESTAMP = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
    r"|^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{1,2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?$"
)
DOCUMENT_NUMBER = r"^[0-9]+([.][0-9]+)?$"
DOCUMENT_TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]?[0-9]{2}:[0-9]{2}:[0-9]{2}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_null_token(c: Column | str) -> Column:
    """True where the trimmed text means "no value" (also for NULL itself)."""
    c = _col(c)
    return c.isNull() | F.lower(F.trim(c)).isin(ENTITY_NULL_TOKENS)


def is_integer(c: Column | str) -> Column:
    """Text of a 64-bit integer; no blanks allowed around it."""
    c = _col(c)
    return c.rlike(INTEGER) & c.try_cast("bigint").isNotNull()


def is_number(c: Column | str) -> Column:
    """Text of a floating point number, with exponent, infinity and NaN forms.

    A finite text too large for a double is not a number.
    """
    c = _col(c)
    value = c.try_cast("double")
    overflow = (F.abs(value) == F.lit(float("inf"))) & c.rlike("[0-9]")
    return c.rlike(FLOAT) & ~F.coalesce(overflow, F.lit(False))


def is_date(c: Column | str) -> Column:
    """``yyyy-mm-dd`` and a real calendar day."""
    c = _col(c)
    return c.rlike(DATE) & F.try_to_date(c, "yyyy-MM-dd").isNotNull()


def is_timestamp(c: Column | str) -> Column:
    """RFC 3339, or ``yyyy-mm-dd hh:mm:ss`` with an optional fraction."""
    c = _col(c)
    return c.rlike(TIMESTAMP) & F.replace(c, F.lit(","), F.lit(".")).try_cast("timestamp").isNotNull()


def is_boolean(c: Column | str) -> Column:
    return F.lower(_col(c)).isin(BOOLEAN_TOKENS)


def _cut(c: Column) -> Column:
    """Whole part of a number text, NULL beyond 64 bits."""
    return c.try_cast("double").try_cast("bigint")


def convert(c: Column | str, declared: Column | str) -> Column:
    """Text to ``struct(value, type, ok)`` by the declared column type.

    Null tokens give a NULL value. In an integer column a text with letters stays
    text and a decimal is cut to its whole part; in a float column a text with
    letters stays text; whatever else does not fit is dropped (``ok`` false).
    Types other than integer, float and text are guessed. Float texts are kept
    as written, so no digit is lost.
    """
    c, declared = _col(c), _col(declared)
    whole, number, lettered, cut = is_integer(c), is_number(c), c.rlike(LETTERS), _cut(c)

    def out(value: Column, kind: str, ok: bool = True) -> Column:
        return F.struct(value.cast("string").alias("value"), F.lit(kind).alias("type"), F.lit(ok).alias("ok"))

    nothing = F.lit(None).cast("string")
    as_integer = (
        F.when(whole, out(c.try_cast("bigint"), "integer"))
        .when(lettered, out(c, "text"))
        .when(number & cut.isNotNull(), out(cut, "integer"))
        .otherwise(out(nothing, "invalid", False))
    )
    as_float = (
        F.when(number, out(c, "float")).when(lettered, out(c, "text")).otherwise(out(nothing, "invalid", False))
    )
    guessed = (
        F.when(whole, out(c.try_cast("bigint"), "integer")).when(number, out(c, "float")).otherwise(out(c, "text"))
    )
    return (
        F.when(is_null_token(c), out(nothing, "null"))
        .when(declared == "integer", as_integer)
        .when(declared == "float", as_float)
        .when(declared == "text", out(c, "text"))
        .otherwise(guessed)
    )


def converted_value(c: Column | str, declared: str) -> Column:
    """``convert(c, declared).value`` for a type known to the driver: the shortest
    expression, without the struct."""
    c = _col(c)
    whole, lettered = is_integer(c), c.rlike(LETTERS)
    if declared == "integer":
        value = (
            F.when(whole, c.try_cast("bigint").cast("string")).when(lettered, c)
            .when(is_number(c), _cut(c).cast("string"))
        )
    elif declared == "float":
        value = F.when(lettered | is_number(c), c)
    elif declared == "text":
        value = c
    else:
        value = F.when(whole, c.try_cast("bigint").cast("string")).otherwise(c)
    return F.when(~is_null_token(c), value)


def holds_text(c: Column | str, declared: str) -> Column:
    """True where a cell of a numeric column can only be kept as text."""
    c = _col(c)
    fits = is_integer(c) if declared == "integer" else is_number(c)
    return c.rlike(LETTERS) & ~fits & ~is_null_token(c)


def type_value(c: Column | str) -> Column:
    """Document typing of a text: ``struct(value, value_type)``.

    Numbers are unsigned; the text is kept (an identifier such as ``007`` loses
    no zero) and the type says how to read it. A date or timestamp that is not a
    real one stays text.
    """
    c = _col(c)

    def out(value: Column, kind: str) -> Column:
        return F.struct(value.cast("string").alias("value"), F.lit(kind).alias("value_type"))

    day = F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd").isNotNull()
    return (
        F.when(c.isNull() | (c == "") | (F.upper(c) == "N.A."), out(F.lit(None), "null"))
        .when(c.rlike(DOCUMENT_NUMBER), out(c, "number"))
        .when(F.lower(c).isin("true", "false"), out(F.lower(c), "boolean"))
        .when(c.rlike(DOCUMENT_TIMESTAMP) & day, out(c, "timestamp"))
        .when(c.rlike(DATE) & day, out(c, "date"))
        .otherwise(out(c, "text"))
    )


def clean_cell(c: Column | str, most: int | None = None) -> Column:
    """Report text: control characters out (tab and line ends stay), one blank for
    an empty cell. ``most`` cuts it for a report with a limit."""
    c = _col(c)
    kept = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    kept = kept if most is None else F.substring(kept, 1, most)
    return F.when(c.isNull() | (c == ""), F.lit(" ")).otherwise(kept)


def name_date_text(name: Column | str) -> Column:
    """First run of eight digits in a file name, NULL where there is none."""
    found = F.regexp_extract(_col(name), r"([0-9]{8})", 1)
    return F.when(found != "", found)


def name_date(name: Column | str) -> Column:
    """Date in a file name; NULL where the digits are no calendar day."""
    return F.try_to_date(name_date_text(name), "yyyyMMdd")


def prefix_path(c: Column | str) -> Column:
    """One path level per character of an identifier."""
    return F.regexp_replace(_col(c), r"(.)(?=.)", "$1/")


def sanitize_name(c: Column | str) -> Column:
    """File name without its last extension as an identifier."""
    base = F.regexp_replace(_col(c), r"(?<=[^.])[.][^.]*$", "")
    return F.regexp_replace(F.regexp_replace(base, r"[^a-zA-Z0-9]+", "_"), r"^_+|_+$", "")


def staged_name(c: Column | str) -> Column:
    """Name of the staging table of a file: readable part plus a short hash."""
    c = _col(c)
    return F.concat(F.lit("temp_"), sanitize_name(c), F.lit("_"), F.substring(F.md5(c), 1, 8))
