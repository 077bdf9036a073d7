"""Checksums in DuckDB SQL, for the statements that check the queries."""

from __future__ import annotations

#: Entry ``x`` of the table of CRC-32; 3988292384 is its reversed polynomial.
CRC_ENTRY = "list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)"


def bytes_sql(text: str) -> str:
    """The UTF-8 bytes of a text as a list of numbers."""
    digit = "strpos('0123456789ABCDEF', substr(hex(encode({0})), {1}, 1)) - 1"
    pair = f"16 * ({digit.format(text, '2 * i + 1')}) + {digit.format(text, '2 * i + 2')}"
    return f"list_transform(range(octet_length(encode({text}))), lambda i: CAST({pair} AS BIGINT))"


def crc32_sql(text: str, table: str) -> str:
    """Unsigned CRC-32 of a text; ``table`` names a column with the list of the 256 ``CRC_ENTRY``."""
    step = f"xor(c >> 8, list_extract({table}, 1 + (xor(c, b) & 255)))"
    return f"xor(list_reduce({bytes_sql(text)}, lambda c, b: {step}, 4294967295::BIGINT), 4294967295::BIGINT)"


def base32_sql(hexadecimal: str) -> str:
    """Upper-case base32 of 40 hexadecimal digits: five of them are four letters."""
    number = "list_reduce(range(5), lambda n, k: n * 16 + strpos('0123456789abcdef', substr({0}, 5 * g + k + 1, 1)) - 1, 0::BIGINT)".format(hexadecimal)
    letter = f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((({number}) >> (15 - 5 * j)) & 31) AS BIGINT), 1)"
    return f"array_to_string(flatten(list_transform(range(8), lambda g: list_transform(range(4), lambda j: {letter}))), '')"
