"""Whether two offers can be the same product, as column predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _unless_null(ok: Column) -> Column:
    return F.coalesce(ok, F.lit(True))


def weights_compatible(a: Column, b: Column) -> Column:
    """Within a quarter of the heavier one, 20 g at most, or within 8 percent of it; unknown weights are compatible."""
    heavy = F.greatest(a, b)
    tolerance = F.greatest(F.least(F.lit(20.0), 0.25 * heavy), 0.08 * heavy)
    return _unless_null(F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= tolerance))


def counts_compatible(a: Column, b: Column) -> Column:
    return _unless_null(a == b)


def types_compatible(a: Column, b: Column) -> Column:
    return _unless_null(a == b)


def overlap_if_known(a: Column, b: Column) -> Column:
    """Sets of percentages: none known on a side, or one in common."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def equal_if_known(a: Column, b: Column) -> Column:
    """Sets of meats: none known on a side, or the same."""
    return (F.size(a) == 0) | (F.size(b) == 0) | (F.array_sort(a) == F.array_sort(b))


def contained(candidate: Column, base: Column) -> Column:
    return F.size(F.array_except(candidate, base)) == 0


def variants_compatible(candidate: dict[str, Column], base: dict[str, Column], symmetric: tuple[str, ...] = ("alcohol_free",)) -> Column:
    """What the candidate claims the base must claim; the symmetric flags must be equal."""
    out = F.lit(True)
    for k in candidate:
        out = out & ((candidate[k] == base[k]) if k in symmetric else (~candidate[k] | base[k]))
    return out


def price_plausible(a: Column, b: Column, most: float = 5.0) -> Column:
    return _unless_null((a <= most * b) & (b <= most * a))


def length_bound(a: Column, b: Column) -> Column:
    """No similarity of the two texts can be higher than this."""
    return 2 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit image hashes differ."""
    return F.bit_count(a.bitwiseXOR(b))


def hash_from_hex(c: Column) -> Column:
    return F.conv(c, 16, -10).try_cast("long")
