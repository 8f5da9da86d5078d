"""A seeded full shuffle of a table by a keyed permutation of its row positions.

``place`` is where a row stands after the shuffle: a bijection of the positions 0 to n - 1, computed for each row by itself, so that nothing is
sorted globally and the order depends on the positions and the seed alone, not on partitions. It is a Feistel network over two
unequal halves (Black and Rogaway 2002): with a = ceil(sqrt(n)) and b = ceil(n / a), a number below a * b is a pair
(left, right), and each round adds a keyed function of one half to the other, modulo that half's size. The few numbers from n on
are walked: the network is applied again until it falls below n. How often that can be needed is worked out beforehand from those numbers, fewer
than sqrt(n), so the plan has that many steps and no row is left over.

All of it is integer arithmetic on columns below 2^62, in generated code, and can be written in SQL as it is.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenance_spark.operators.positions import with_positions
from provenance_spark.session import shuffle_partitions

ROUNDS = 6
#: A prime: products of two residues stay below 2^62.
PRIME = (1 << 31) - 1
LIMIT = 1 << 60


@dataclass(frozen=True)
class Permutation:
    """The network for ``n`` positions and a seed: half sizes, round keys and the number of applications."""

    n: int
    a: int
    b: int
    keys: tuple[tuple[int, int, int], ...]
    times: int


def round_keys(seed: int | str) -> tuple[tuple[int, int, int], ...]:
    """Three residues a round from the MD5 of ``seed:round``."""
    digests = [hashlib.md5(f"{seed}:{r}".encode()).digest() for r in range(ROUNDS)]
    return tuple(tuple(1 + int.from_bytes(d[4 * i:4 * i + 4], "big") % (PRIME - 1) for i in range(3)) for d in digests)


def permutation(n: int, seed: int | str) -> Permutation:
    if n >= LIMIT:
        raise ValueError("too many rows")
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))
    keys = round_keys(seed)
    p = Permutation(n, a, b, keys, 1)
    outside = np.arange(n, a * b, dtype=np.int64)  # fewer than a
    times = 1
    while len(outside):  # those that a number below n may meet: walk them until all have come back, or only rings are left
        nxt = apply_once(p, outside)
        nxt = nxt[nxt >= n]
        if len(nxt) == len(outside) and np.array_equal(np.sort(nxt), np.sort(outside)):
            break
        outside, times = nxt, times + 1
    return Permutation(n, a, b, keys, times)


def apply_once(p: Permutation, x: np.ndarray) -> np.ndarray:
    """One application to numbers below a * b."""
    left, right = x // p.b, x % p.b
    for r, (k1, k2, k3) in enumerate(p.keys):
        half = right if r % 2 == 0 else left
        f = (half % PRIME * k1 + k2) % PRIME
        f = (f * f + k3) % PRIME
        f = (f * f + half) % PRIME
        if r % 2 == 0:
            left = (left + f) % p.a
        else:
            right = (right + f) % p.b
    return left * p.b + right


def with_place(df: DataFrame, pos: Column, p: Permutation | Mapping[object, Permutation], to: str = "place", by: Column | None = None) -> DataFrame:
    """``df`` with the place of each row after the shuffle; ``pos`` numbers the rows from 0 to n - 1.

    With several permutations of one seed, by the value of ``by``, each group is shuffled by its own.
    """
    groups = p if isinstance(p, Mapping) else {None: p}
    every = list(groups.values())
    if len({q.keys for q in every}) != 1:
        raise ValueError("the groups' permutations have different seeds")

    def size(name: str) -> Column:
        if by is None:
            return F.lit(getattr(every[0], name)).cast("long")
        return F.create_map(*[x for g, q in groups.items() for x in (F.lit(g), F.lit(getattr(q, name)).cast("long"))])[by]

    n, a, b = f"_{to}_n", f"_{to}_a", f"_{to}_b"
    x, left, right, f = f"_{to}_x", f"_{to}_l", f"_{to}_r", f"_{to}_f"
    out = df.withColumns({x: pos.cast("long"), n: size("n"), a: size("a"), b: size("b")})
    for t in range(max(q.times for q in every)):
        out = out.withColumns({left: F.expr(f"`{x}` div `{b}`"), right: F.pmod(F.col(x), F.col(b))})
        for r, (k1, k2, k3) in enumerate(every[0].keys):
            this, other, modulus = (left, right, a) if r % 2 == 0 else (right, left, b)
            half = F.col(other)
            out = out.withColumn(f, (half % PRIME * F.lit(k1).cast("long") + k2) % PRIME)
            out = out.withColumn(f, (F.col(f) * F.col(f) + k3) % PRIME)
            out = out.withColumn(this, (F.col(this) + (F.col(f) * F.col(f) + half) % PRIME) % F.col(modulus))
        new = F.col(left) * F.col(b) + F.col(right)
        out = out.withColumn(x, new if t == 0 else F.when(F.col(x) >= F.col(n), new).otherwise(F.col(x)))
    return out.withColumn(to, F.col(x)).drop(x, n, a, b, left, right, f)


def shuffled(df: DataFrame, place: str, n: int, partitions: int | None = None) -> DataFrame:
    """The rows in the order of ``place``: partition i holds the i-th range of places, sorted within.

    A row's place gives its partition directly, so rows cross the network once and no range is sampled.
    """
    parts = partitions or shuffle_partitions(df.sparkSession)
    each = max(1, -(-n // parts))
    return df.repartitionById(parts, F.expr(f"CAST(`{place}` div {each}L AS INT)")).sortWithinPartitions(place)


def shuffle_table(df: DataFrame, order_by: list[str], seed: int | str, partitions: int | None = None, to: str = "place") -> DataFrame:
    """L1 / L2: ``df`` in a seeded random order of its rows as ``order_by`` (a total order) numbers them, with their ``place``.

    The numbering takes the key columns alone; an empty table stays empty.
    """
    keys = with_positions(df.select(*order_by), order_by, pos_col=f"_{to}_pos")
    n = keys.count()
    placed = with_place(keys, F.col(f"_{to}_pos"), permutation(n, seed), to).drop(f"_{to}_pos")
    return shuffled(df.join(placed, order_by), to, n, partitions)


def place_sql(seed: int | str, columns: str, source: str, times: int = 6, name: str = "placed") -> str:
    """Common table expressions (DuckDB) that end in ``name``: ``columns`` of ``source`` and ``place``, by the same arithmetic.

    ``source`` has a position ``pos`` and the number of positions ``n`` in each row. Steps beyond those needed change nothing.
    """
    ctes = [f"{name}_0 AS (SELECT *, CAST(pos AS BIGINT) AS x, CAST(ceil(sqrt(n)) AS BIGINT) AS a, "
            f"(n + CAST(ceil(sqrt(n)) AS BIGINT) - 1) // CAST(ceil(sqrt(n)) AS BIGINT) AS b FROM {source})"]
    last = f"{name}_0"
    for t in range(times):
        ctes.append(f"{name}_{t}s AS (SELECT *, x // b AS l, x % b AS r FROM {last})")
        last = f"{name}_{t}s"
        for r, (k1, k2, k3) in enumerate(round_keys(seed)):
            this, other, size = ("l", "r", "a") if r % 2 == 0 else ("r", "l", "b")
            now = f"{name}_{t}_{r}"
            ctes.append(f"{now}f AS (SELECT *, (({other} % {PRIME}) * {k1} + {k2}) % {PRIME} AS f FROM {last})")
            ctes.append(f"{now}g AS (SELECT * EXCLUDE (f), (f * f + {k3}) % {PRIME} AS g FROM {now}f)")
            ctes.append(f"{now} AS (SELECT * EXCLUDE (g) REPLACE (({this} + (g * g + {other}) % {PRIME}) % {size} AS {this}) FROM {now}g)")
            last = now
        keep = "l * b + r" if t == 0 else "CASE WHEN x >= n THEN l * b + r ELSE x END"
        ctes.append(f"{name}_{t + 1} AS (SELECT * EXCLUDE (l, r) REPLACE ({keep} AS x) FROM {last})")
        last = f"{name}_{t + 1}"
    return ",\n".join([*ctes, f"{name} AS (SELECT {columns}, x AS place FROM {last})"])
