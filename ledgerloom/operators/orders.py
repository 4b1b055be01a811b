"""A keyed order of 0 .. n - 1 that needs no sort: each number finds its place by itself."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 4
#: Steps of a walk out of the numbers from n on, which one of about sqrt(n) needs at all; a longer walk raises.
STEPS = 64


def _key(value: Column, seed: int, turn: int, limit: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(turn)), value.cast("string"))), 1, 8), 16, 10).cast("long") % limit


def _mixed(x: Column, a: int, b: int, seed: int) -> Column:
    """A bijection of 0 .. a * b - 1: the two digits of a number are added to by turns, each by what the other gives."""
    pair = F.struct((x % a).alias("low"), F.floor(x / a).alias("high"))
    for turn in range(ROUNDS):

        def step(p: Column, turn: int = turn) -> Column:
            low, high = p["low"], p["high"]
            if turn % 2 == 0:
                return F.struct(((low + _key(high, seed, turn, a)) % a).alias("low"), high.alias("high"))
            return F.struct(low.alias("low"), ((high + _key(low, seed, turn, b)) % b).alias("high"))

        pair = F.get(F.transform(F.array(pair), _single(step)), F.lit(0))
    return F.get(F.transform(F.array(pair), lambda p: p["low"] + p["high"] * a), F.lit(0))


def _single(f):
    return lambda p: f(p)


def place(index: Column, n: int, seed: int) -> Column:
    """The place of each of 0 .. n - 1 in the order that the seed gives: a bijection, whatever the partitions of the rows."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))
    walk = F.aggregate(F.sequence(F.lit(2), F.lit(STEPS)), _mixed(index, a, b, seed), lambda x, _: F.when(x < n, x).otherwise(_mixed(x, a, b, seed)))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("the walk is too long")).cast("long"))


def shuffled(plan: DataFrame, index: str, seed: int, name: str = "place") -> DataFrame:
    """Adds the place of each row in the seeded order. index: consecutive numbers from 0."""
    return plan.withColumn(name, place(F.col(index).cast("long"), plan.count(), seed))


def block_order(specs: DataFrame, path: str, keys: list[str], ordinal: str) -> DataFrame:
    """The first spec, by ``ordinal``, of each path, in order of the keys and the path's last part."""
    first = specs.groupBy(path).agg(F.min_by(F.struct(*specs.columns), ordinal).alias("_r")).select("_r.*")
    return first.orderBy(*keys, F.element_at(F.split(path, "/"), -1))
