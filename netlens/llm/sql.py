"""Pieces of DuckDB statements that several operators' oracles share."""

from __future__ import annotations

import string

LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

# The table of CRC-32 (reflected polynomial 0xEDB88320), one row, to be listed in FROM.
CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c
  FROM range(256) AS x(i)))"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, beside ``crc_table`` in FROM."""
    digits = f"hex(encode({text}))"
    data = f"list_transform(range(length({digits}) // 2), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT)"
    return (f"xor(4294967295, list_reduce({data}, lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), "
            f"4294967295::BIGINT))")
