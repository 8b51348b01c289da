"""A keyed shuffle of numbered rows: every row computes its new place by itself, so nothing is sorted.

Swap-or-not: in each round a number x of 0..n-1 is paired with (key - x) mod n, and one bit drawn for the pair (a hash
of its larger member and the round) says whether the two change places. A round undoes itself and works for any n, so
the rounds are a bijection, and in reverse order its inverse.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 40
# Fixed value: an odd multiplier below 2^31, so that its products with 32-bit numbers stay below 2^63.
MULTIPLIER = 1540483477
_MASK = (1 << 32) - 1


def round_keys(seed: int, stream: int) -> list[tuple[int, int]]:
    """Two 32-bit numbers for each round, from a digest of seed, stream and round."""
    digests = [hashlib.md5(f"{seed}|{stream}|{at}".encode(), usedforsecurity=False).hexdigest() for at in range(ROUNDS)]
    return [(int(text[:8], 16), int(text[8:16], 16)) for text in digests]


def _bit(number: Column, key: Column) -> Column:
    folded = number.bitwiseXOR(F.shiftright(number, 32)).bitwiseXOR(key).bitwiseAND(F.lit(_MASK))
    once = (folded * F.lit(MULTIPLIER)).bitwiseAND(F.lit(_MASK))
    twice = (once.bitwiseXOR(F.shiftright(once, 15)) * F.lit(MULTIPLIER)).bitwiseAND(F.lit(_MASK))
    return F.shiftright(twice, 16).bitwiseAND(F.lit(1))


def shuffled_place(place: Column, count: Column, seed: int, stream: int, inverse: bool = False) -> Column:
    """The place (0..count-1) that the row at `place` takes in shuffle number `stream`; with `inverse`, the place whose
    row comes to `place`."""
    keys = round_keys(seed, stream)
    rounds = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in (keys[::-1] if inverse else keys)])

    def step(x: Column, key: Column) -> Column:
        other = (key["a"] % count + count - x) % count
        return F.when(_bit(F.greatest(x, other), key["b"]) == 1, other).otherwise(x)

    return F.aggregate(rounds, place.cast("bigint"), step)
