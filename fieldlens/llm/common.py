"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SALTS = 16


def text_of(column: str) -> Column:
    """The text; a missing one counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than blanks and control white space."""
    return F.array_remove(F.split(text, SPACES, -1), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, ascii_uppercase, ascii_lowercase))


def free_names(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` doesn't have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    return [c for c in (f"_x{k}" for k in range(n + len(taken))) if c not in taken][:n]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def text_key(text: Column) -> dict[str, Column]:
    """128 bits that stand for a text."""
    return {"_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit(1), text)}


def salted_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread_by: Column, salts: int = SALTS) -> DataFrame:
    """Left join where ``right`` has one row per key and a key may hold a large share of ``left``.

    Null keys match each other.  Rows of a key on the left are dealt over ``salts`` tasks, the single row on the right is
    copied to each of them.
    """
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    right = right.withColumn("_r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = left.withColumn("_salt", F.pmod(spread_by, F.lit(salts)).cast("int"))
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col("_salt") == F.col("_r_salt")]
    return left.join(right, on, "left").drop("_salt", "_r_salt", *[f"_r_{k}" for k in keys])


# table of the cyclic redundancy check and a macro for it, to stand in front of other parts of a WITH RECURSIVE
CRC32_SQL = r"""
crc_steps(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS crc FROM crc_steps WHERE k = 8)"""


def crc32_sql(value: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in DuckDB; needs ``crc`` of ``crc_table`` in scope."""
    byte = f"('0x' || hex(encode({value}))[2 * j + 1:2 * j + 2])::BIGINT"
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen({value})), lambda j: {byte})), "
        "lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"
    )
