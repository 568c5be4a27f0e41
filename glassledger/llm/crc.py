"""CRC-32 of a whole number's decimal text, for engines without such a function (Spark has ``crc32``)."""

#: Two common table expressions for ``WITH RECURSIVE``; ``crc`` holds the table of the polynomial 0xEDB88320.
TABLES = """bits(i, k, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) t FROM bits WHERE k = 8)"""


def crc32_sql(number: str) -> str:
    """The unsigned CRC-32 of ``number``'s decimal text; ``crc`` must be in the FROM clause."""
    letters = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return (f"xor(list_reduce(list_prepend(4294967295, {letters}), "
            "lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INT) + 1])), 4294967295)")
