"""Pairs of 64-bit fingerprints that differ in few bits, by multi-index hashing.

A fingerprint is cut into parts. Up to seven differing bits over four parts leave one part with at most one of them, so one side looks up each of its parts
and all values one bit away from it among the other side's parts: two random fingerprints meet with a chance of 68 in 65,536. Up to
three differing bits leave three of six parts untouched, so any three parts together are a key of 32 bits: 20 in 2^32.

Bits are dealt to parts by how much they vary, so that bits which are the same in all rows don't make one part of no use; each pair is
told by the first part at which it meets alone; and part values that very many rows share are split."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkslide.operators.skew import split_keys

BITS = 64
#: Differing bits up to which three of six parts are looked up together.
TRIPLES_UP_TO = 3
MOST_BITS = 7


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


#: Share of rows that a bit differs in, at least, for bits to be left where they are.
VARIED = 0.1


def dealt_bits(rows: DataFrame, fp: str, parts: int) -> list[int]:
    """The order of bits in which each part has its share of those that vary; as they are if all do. The counts are one row."""
    ones = rows.agg(F.count(fp), *(F.count_if(F.getbit(F.col(fp), F.lit(b)) == 1) for b in range(BITS))).first()
    rarer = [min(n, ones[0] - n) for n in ones[1:]]
    if min(rarer) >= VARIED * ones[0]:
        return list(range(BITS))
    varied = sorted(range(BITS), key=lambda b: (-rarer[b], b))
    return [b for i in range(parts) for b in varied[i::parts]]


def rearranged(fp: Column, order: list[int]) -> Column:
    """fp with its bits in another order, which leaves distances as they are."""
    if order == list(range(BITS)):
        return fp
    one = F.lit(1).cast("long")
    return reduce(Column.bitwiseOR, (F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(one), i) for i, b in enumerate(order)))


def part(fp: Column, parts: int, i: int) -> Column:
    """Part i of a fingerprint. Of 64 bits, the first parts have one more than others where they can't have the same."""
    first, width = _part_bits(parts, i)
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _part_bits(parts: int, i: int) -> tuple[int, int]:
    width, more = divmod(BITS, parts)
    return i * width + min(i, more), width + (i < more)


def _key(place: int, value: Column) -> Column:
    return F.struct(F.lit(place).alias("place"), value.alias("value"))


def _four(fp: Column, x: Column) -> tuple[Column, list[int], Column]:
    """The keys of a fingerprint, the differences that the asking side adds to each, and the place that tells a pair (x: its differing bits)."""
    tells = F.coalesce(*(F.when(F.bit_count(part(x, 4, i)) <= 1, F.lit(i)) for i in range(4)))
    return F.array(*(_key(i, part(fp, 4, i)) for i in range(4))), [0, *(1 << b for b in range(BITS // 4))], tells


def _triples(fp: Column, x: Column) -> tuple[Column, list[int], Column]:
    sets = list(combinations(range(6), 3))
    value = lambda three: reduce(lambda v, i: F.shiftleft(v, 11).bitwiseOR(part(fp, 6, i)), three[1:], part(fp, 6, three[0]))
    mask = lambda three: sum(((1 << w) - 1) << at for at, w in (_part_bits(6, i) for i in three))
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    keys = F.array(*(_key(p, value(three)) for p, three in enumerate(sets)))
    tells = F.coalesce(*(F.when(x.bitwiseAND(F.lit(signed(mask(three))).cast("long")) == 0, F.lit(p)) for p, three in enumerate(sets)))
    return keys, [0], tells


def candidates(asking: DataFrame, asked: DataFrame, fp: str, most: int, pair: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Columns of asking as a_..., of asked as b_..., of rows that share a key and are equal in the columns `by`, for all pairs whose fingerprints differ in at most `most` bits and some others;
    place: where they meet, place_of_pair: the one that counts. pair: a condition on a pair that is tested as it is met."""
    if not 0 <= most <= MOST_BITS:
        raise ValueError(f"only up to {MOST_BITS} differing bits leave a part with at most one")
    few = most <= TRIPLES_UP_TO
    order = dealt_bits(asked, fp, 6 if few else 4)
    keys, near, tells = (_triples if few else _four)(F.col("_bits"), F.col("x"))
    by = by or []

    def side(t: DataFrame, to: str) -> DataFrame:
        columns = [F.col(c).alias(c if c in by else f"{to}_{c}") for c in t.columns]
        known = t.where(F.col(fp).isNotNull()).withColumn("_bits", rearranged(F.col(fp), order))
        return known.select(*columns, F.col("_bits").alias(f"{to}__bits"), F.explode(keys).alias("k")).select("*", "k.place", "k.value").drop("k")

    a, b, on = side(asking, "a"), side(asked, "b"), [*by, "place", "value"]
    if len(near) > 1:
        a = a.withColumn("_near", F.explode(F.array(*(F.lit(n).cast("long") for n in near)))).withColumn("value", F.col("value").bitwiseXOR(F.col("_near"))).drop("_near")
    a, b = split_keys(a, b, on, F.xxhash64(*(c for c in b.columns if c not in on)))
    # by shuffle: Spark estimates the exploded sides by the files they come from, up to 68 times too small, and would broadcast them
    met = a.join(b.hint("merge"), [*on, "_salt"])
    met = met.where(pair) if pair is not None else met
    return met.withColumn("x", F.col("a__bits").bitwiseXOR(F.col("b__bits"))).withColumn("place_of_pair", tells).drop("a__bits", "b__bits")


def near_fingerprints(asking: DataFrame, asked: DataFrame, fp: str, most: int, pair: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Columns a_... and b_... and distance of all pairs whose fingerprints differ in at most `most` bits, each once."""
    met = candidates(asking, asked, fp, most, pair, by)
    near = met.where((F.bit_count("x") <= most) & (F.col("place") == F.col("place_of_pair")))
    return near.withColumn("distance", F.bit_count("x")).drop("place", "value", "_salt", "x", "place_of_pair")
