"""Word shingles as 64-bit hashes, and connected components by repeated joins."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, words

WIDTH = 5
MEMO_ENTRIES = 400_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of a public hash), one for each seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Hashes words once each and combines WIDTH neighbours by a polynomial."""

    def __init__(self):
        self.memo = _WordHashes()

    def word_hashes(self, found: list[bytes]) -> np.ndarray:
        if len(self.memo) > MEMO_ENTRIES:
            self.memo.clear()
        return np.fromiter(map(self.memo.__getitem__, found), np.uint64, len(found))

    def sequence(self, text: str | None) -> np.ndarray:
        """The shingles in order; with fewer words than WIDTH, the whole as one; none without words."""
        found = words(text)
        if not found:
            return np.empty(0, np.uint64)
        h = self.word_hashes(found)
        width = min(WIDTH, len(h))
        out = np.full(len(h) - width + 1, width, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(width):
                out = out * _FACTOR + h[i : len(h) - width + 1 + i]
        return mixed(out)

    def distinct(self, text: str | None) -> np.ndarray:
        return np.unique(self.sequence(text))


def exact_shingles(text: str | None, width: int = WIDTH) -> set[tuple[bytes, ...]]:
    """The shingles themselves, for checks."""
    found = words(text)
    if not found:
        return set()
    if len(found) < width:
        return {tuple(found)}
    return set(zip(*(found[i:] for i in range(width)), strict=False))


def components(links: DataFrame, folder: str, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """node, component: the smallest node reachable over links, for every node that has one.

    Alternates large-star and small-star steps, each a grouped minimum and a join; every step is
    written to the shared folder, so the plan stays short and a lost executor costs one step.
    The links of a node with very many neighbours are aggregated in each task first.
    """
    edges = links.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).where("low < high").distinct()
    edges = materialize(edges, f"{folder}/edges-0")
    for i in range(1, rounds + 1):
        both = edges.select(F.col("high").alias("node"), F.col("low").alias("other")).union(edges.select(F.col("low"), F.col("high")))
        least = both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("least"))
        # large star: every larger neighbour of a node goes to the least of its neighbourhood
        large = both.where("other > node").join(least, "node").select(F.col("least").alias("low"), F.col("other").alias("high")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        small = large.groupBy("high").agg(F.min("low").alias("least"))
        moved = large.join(small, "high").select(F.col("least").alias("low"), F.col("low").alias("mid"), "high")
        after = moved.select("low", "high").union(moved.select("low", F.col("mid").alias("high"))).where("low < high").distinct()
        after = materialize(after, f"{folder}/edges-{i}")
        # done when every node has one link and no least node hangs on another
        low = after.select(F.col("low").alias("node"), F.lit(1).alias("is_low"), F.lit(0).alias("n_high"))
        high = after.select(F.col("high").alias("node"), F.lit(0).alias("is_low"), F.lit(1).alias("n_high"))
        state = low.union(high).groupBy("node").agg(F.max("is_low").alias("is_low"), F.sum("n_high").alias("n_high"))
        open_nodes = state.where("n_high > 1 or (n_high > 0 and is_low > 0)")
        edges = after
        if open_nodes.isEmpty():
            break
    else:
        raise RuntimeError(f"components need more than {rounds} rounds")
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).union(edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
