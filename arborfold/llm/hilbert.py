"""The Hilbert curve in any number of dimensions as a small table of states, and as Spark or SQL expressions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=8)
def states(dims: int) -> tuple[list[int], list[int]]:
    """(digit, next state) by state * 2**dims + cell, for the cell of a cube that a bit of each coordinate names.

    A state is an entry corner and a direction; both come from the Gray code (Hamilton's formulation).
    """
    size = 1 << dims

    def rotate(x: int, by: int) -> int:
        by %= dims
        return ((x >> by) | (x << (dims - by))) & (size - 1)

    def trailing_ones(i: int) -> int:
        n = 0
        while i >> n & 1:
            n += 1
        return n

    known, todo, digits, after = {(0, 0): 0}, [(0, 0)], [], []
    for entry, direction in todo:
        row = [(0, 0)] * size
        for cell in range(size):
            gray, digit = rotate(cell ^ entry, direction + 1), 0
            x = gray
            while x:
                digit ^= x
                x >>= 1
            corner = 0 if digit == 0 else (2 * ((digit - 1) // 2)) ^ ((2 * ((digit - 1) // 2)) >> 1)
            turn = 0 if digit == 0 else trailing_ones(digit - 1 if digit % 2 == 0 else digit) % dims
            back = rotate(corner, dims - (direction + 1) % dims)
            to = entry ^ back, (direction + turn + 1) % dims
            if to not in known:
                known[to] = len(known)
                todo.append(to)
            row[cell] = digit, known[to]
        digits += [d for d, _ in row]
        after += [s for _, s in row]
    return digits, after


def index(coordinates: list[Column], bits: int) -> Column:
    """The curve index of non-negative integer coordinates of ``bits`` bits, by built-in expressions."""
    dims = len(coordinates)
    digits, after = (F.array(*(F.lit(v) for v in t)) for t in states(dims))
    start = F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h"))

    def step(acc: Column, bit: Column) -> Column:
        cell = F.lit(0)
        for c in coordinates:
            cell = cell * 2 + F.call_function("shiftright", c.cast("int"), bit) % 2
        at = acc["s"] * (1 << dims) + cell
        return F.struct(F.get(after, at).alias("s"), (acc["h"] * (1 << dims) + F.get(digits, at)).alias("h"))

    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0)), start, step, lambda acc: acc["h"])


def index_of(point: tuple[int, ...], bits: int) -> int:
    """The same in plain Python."""
    dims = len(point)
    digits, after = states(dims)
    s = h = 0
    for k in range(bits - 1, -1, -1):
        cell = 0
        for c in point:
            cell = cell * 2 + (c >> k & 1)
        at = s * (1 << dims) + cell
        s, h = after[at], h * (1 << dims) + digits[at]
    return h
