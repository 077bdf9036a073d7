"""Number and text rendering that equals Python's, as plain column expressions.

Spark's own casts and ``format_string`` differ from Python in three places: they
switch to scientific notation earlier, they round halves of the shortest decimal
up, and ``initcap`` only looks at blanks. Tokens are text, so these differences
would change vocabularies; everything here stays in whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = r"\d(?:_?\d)*"
FLOAT_TEXT = (
    rf"^\s*[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    r"|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"
)
WHITESPACE = " \t\n\r\f\x0b"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def float_or_null(text: Column) -> Column:
    """Text as a double where Python's ``float`` accepts it, else null."""
    plain = F.replace(strip(text), F.lit("_"), F.lit(""))
    return F.when(text.rlike(FLOAT_TEXT), plain.try_cast("double"))


def float_text(number: Column) -> Column:
    """A double as Python's ``str`` writes it: ``45.0``, ``0.0001``, ``1e-05``, ``1e+16``."""
    java = number.cast("string")
    size = F.abs(number)
    sign = F.when(java.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    body = F.ltrim(java, F.lit("-"))
    mantissa = F.substring_index(body, "E", 1)
    exponent = F.substring_index(body, "E", -1).try_cast("int")
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), r"(?<=.)0+$", "")

    # Each use of a part repeats its code in the generated method, which is only compiled while it is short.
    filled = F.rpad(digits, 40, "0")
    pointed = F.concat(sign, F.substring(filled, F.lit(1), exponent + 1), F.lit("."), F.substring(filled, exponent + 2, F.lit(40)))
    large = F.regexp_replace(pointed, r"(\.\d+?)0+$", "$1")
    small = F.concat(sign, F.lit("0.000"), digits)
    short = F.regexp_replace(digits, "^(.)(.+)$", "$1.$2")
    power = F.abs(exponent).cast("string")
    padded = F.when(F.length(power) < 2, F.concat(F.lit("0"), power)).otherwise(power)
    scientific = F.concat(
        sign, short, F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")), padded
    )
    return (
        F.when(F.isnan(number), F.lit("nan"))
        .when(java == "Infinity", F.lit("inf"))
        .when(java == "-Infinity", F.lit("-inf"))
        .when(~java.contains("E"), java)
        .when((size >= 1e7) & (size < 1e16), large)
        .when((size >= 1e-4) & (size < 1e-3), small)
        .otherwise(scientific)
    )


def fixed_text(number: Column, decimals: int) -> Column:
    """A double with a fixed number of decimals, as Python's ``f"{x:.1f}"`` writes it.

    ``format_number`` with a pattern rounds half to even on the exact binary
    value (0.15 is below its tie, 0.25 is on it); ``round`` and ``format_string``
    do not.
    """
    pattern = "0." + "0" * decimals if decimals else "0"
    return (
        F.when(F.isnan(number), F.lit("nan"))
        .when(number == float("inf"), F.lit("inf"))
        .when(number == float("-inf"), F.lit("-inf"))
        .otherwise(F.call_function("format_number", number, F.lit(pattern)))
    )


def title_text(text: Column) -> Column:
    """Python's ``str.title``: every run of letters starts with a capital."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    cased = F.transform(
        runs,
        lambda run: F.concat(
            F.upper(F.substring(run, 1, 1)), F.lower(F.substring(run, F.lit(2), F.length(run)))
        ),
    )
    return F.array_join(cased, "")


def part(code: Column, index: int) -> Column:
    """Part of a ``//`` hierarchy, null where there is none."""
    return F.get(F.split(code, "//"), F.lit(index))
