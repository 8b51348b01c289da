"""Integer hashes made of plain 64-bit arithmetic, so every engine computes the same values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Multiplier and modulus of the multiplicative entity hash.
HASH_MULTIPLIER = 2654435761
HASH_MODULUS = 2**32

_MASK = HASH_MODULUS - 1


def entity_hash(entity: Column) -> Column:
    """(id * multiplier) mod 2^32. The id is first reduced mod 2^32 and multiplied in two 16-bit
    halves, so no id overflows and negative ids wrap as unsigned ones do."""
    low32 = entity.cast("bigint").bitwiseAND(F.lit(_MASK))
    low = low32.bitwiseAND(F.lit(0xFFFF))
    high = F.shiftright(low32, 16)
    high_part = F.shiftleft((high * F.lit(HASH_MULTIPLIER)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low * F.lit(HASH_MULTIPLIER) + high_part).bitwiseAND(F.lit(_MASK))


def in_sample(entity: Column, share: float) -> Column:
    """Whether the entity's hash lies in the first `share` (above 0, at most 1) of its range."""
    if share <= 0 or share > 1:
        raise ValueError(f"a sample share lies above 0 and is 1 at most, not {share}")
    return entity_hash(entity) < F.lit(int(share * HASH_MODULUS))


def sample_entities(df: DataFrame, share: float, entity: str) -> DataFrame:
    """A deterministic sample of whole entities."""
    return df.filter(in_sample(F.col(entity), share))


def hex_draw(digest: Column, slot: Column) -> Column:
    """The 32-bit number in one of the four 8-digit slots (0 to 3) of an MD5 digest."""
    start = (slot * 8 + 1).cast("int")
    return F.conv(F.substr(digest, start, F.lit(8)), 16, 10).cast("bigint")


def text_digest(*parts: Column) -> Column:
    """MD5 of the parts joined as text: the same in every engine, and on every retry of a task."""
    return F.md5(F.concat_ws("|", *[part.cast("string") for part in parts]))
