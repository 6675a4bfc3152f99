"""Seeded generators that other data depends on bit by bit."""

from __future__ import annotations

import numpy as np


def mulberry32(seed: int, n: int) -> np.ndarray:
    """The first n draws in [0, 1) of the public-domain mulberry32 generator; the state is a counter, so all draws come at once."""
    word = np.uint64(0xFFFFFFFF)
    a = (np.uint64(seed & 0xFFFFFFFF) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x6D2B79F5)) & word
    t = ((a ^ (a >> np.uint64(15))) * (a | np.uint64(1))) & word
    t ^= (t + (((t ^ (t >> np.uint64(7))) * (t | np.uint64(61))) & word)) & word
    return ((t ^ (t >> np.uint64(14))) & word).astype(np.float64) / 4294967296.0


def mulberry_sql(seed: str, rows: str, keep: str, n: str) -> str:
    """DuckDB SQL of the n-th draw for each of `rows`: `keep` and draw, in unsigned integer arithmetic."""
    word = "4294967295::UBIGINT"
    step = f"SELECT {keep}, (({seed} + {n} * 1831565813) & 4294967295)::UBIGINT AS a FROM ({rows})"
    one = f"SELECT {keep}, (xor(a, a >> 15) * (a | 1::UBIGINT)) & {word} AS a FROM ({step})"
    two = f"SELECT {keep}, xor(a, (a + ((xor(a, a >> 7) * (a | 61::UBIGINT)) & {word})) & {word}) AS a FROM ({one})"
    return f"SELECT {keep}, (xor(a, a >> 14) & {word})::DOUBLE / 4294967296.0 AS draw FROM ({two})"


class Mulberry:
    """Draw after draw, in blocks behind the scenes."""

    def __init__(self, seed: int, block: int = 4096):
        self.seed, self.block, self.used, self.at = seed, block, 0, block
        self.values: list[float] = []

    def __call__(self) -> float:
        if self.at >= len(self.values):
            shifted = (self.seed + self.used * 0x6D2B79F5) & 0xFFFFFFFF
            self.values, self.at = mulberry32(shifted, self.block).tolist(), 0
            self.used += self.block
        self.at += 1
        return self.values[self.at - 1]


def shuffled(items: list, seed_draw) -> list:
    """Fisher-Yates from the end, one draw a swap."""
    out = list(items)
    for i in range(len(out) - 1, 0, -1):
        j = int(seed_draw() * (i + 1))
        out[i], out[j] = out[j], out[i]
    return out


def spread_hash(seed: int, size: int) -> int:
    """Multiplicative hash into range(size): the product is a double before it is cut to 32 bits."""
    return (int(float(seed) * 2654435761.0) & 0xFFFFFFFF) % size
