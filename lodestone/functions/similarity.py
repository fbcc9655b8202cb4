"""Similarities of pairs of strings, 0 to 1. Token and number overlaps are expressions; edit-based ones are Arrow UDFs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import tokens


def _masks(a: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _common(a_size: int, masks: dict[str, int], b: str) -> int:
    """Length of the longest common subsequence, a column of the table at a time in the bits of one number. Bits beyond
    a_size change none below and are cut off now and then; a character that a lacks changes nothing."""
    full = v = (1 << a_size) - 1
    for start in range(0, len(b), 64):
        for c in b[start : start + 64]:
            if c in masks:
                u = v & masks[c]
                v = v + u | v ^ u
        v &= full
    return a_size - v.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths; 1 for two empty strings."""
    if a == b:
        return 1.0
    return 2 * _common(len(a), _masks(a), b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer one, or with a shorter one at either end."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return float(not b)
    if a in b:
        return 1.0
    masks, n, best = _masks(a), len(a), 0.0
    free = Counter(a)  # of each character how often a has it more than the window
    shared, s = 0, 1 - n  # characters in common, in any order
    for end in range(1, len(b) + n):
        start = end - n
        if end <= len(b):
            c = b[end - 1]
            shared += free[c] > 0
            free[c] -= 1
        if start > 0:
            c = b[start - 1]
            free[c] += 1
            shared -= free[c] > 0
        if start < s:
            continue
        part = min(end, len(b)) - max(start, 0)
        if 2 * min(shared, part) <= best * (n + part):
            continue
        common = _common(n, masks, b[max(start, 0) : end])
        best = max(best, 2 * common / (n + part))
        # a step to the right adds one common character at most, and changes the size by one at most
        s = start + 1
        while s < len(b) and 2 * (common + s - start) <= best * (n + min(s + n, len(b)) - max(s, 0)):
            s += 1
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best ratio among the common tokens and the common tokens with either side's own; 1 if one side has no own."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 1.0
    one, other = (f"{both} {' '.join(sorted(own))}".strip() for own in (x - y, y - x))
    best = ratio(one, other)
    return max(best, ratio(both, one), ratio(both, other)) if both else best


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised by a tenth of the rest for each of up to four equal first characters if it is over 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    masks, free, used, right = _masks(a), (1 << len(a)) - 1, 0, []
    for j, c in enumerate(b):
        lo = max(0, j - reach)
        near = masks.get(c, 0) & free & ((1 << (j + reach + 1)) - 1) >> lo << lo
        if near:
            bit = near & -near  # the first of a's free equal characters within reach
            free ^= bit
            used |= bit
            right.append(c)
    if not right:
        return 0.0
    left = [c for i, c in enumerate(a) if used >> i & 1]
    m = len(left)
    jaro = (m / len(a) + m / len(b) + (m - sum(x != y for x, y in zip(left, right)) // 2) / m) / 3
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(len(a), len(b), 4))
    return jaro + 0.1 * same * (1 - jaro) if jaro > 0.7 else jaro


#: The scorers by name. Others may be added; features and pruner are configured by these names.
SCORERS: dict[str, Callable[[str, str], float]] = {"ratio": ratio, "partial_ratio": partial_ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio, "jaro_winkler": jaro_winkler}


def string_similarity(left: Column, right: Column, names: list[str], guard: bool = True) -> Column:
    """A struct with a double for each scorer, from one Arrow batch; equal pairs of a batch are computed once. guard: 0
    where either side is empty."""
    scorers = {n: SCORERS[n] for n in names}

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def scored(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        known: dict[tuple[str, str], tuple] = {}
        rows = []
        for pair in zip(a.fillna(""), b.fillna("")):
            if pair not in known:
                empty = guard and not (pair[0] and pair[1])
                known[pair] = tuple(0.0 if empty else f(*pair) for f in scorers.values())
            rows.append(known[pair])
        return pd.DataFrame(rows, columns=list(scorers), dtype="float64")

    return scored(left, right)


def _size(x: Column) -> Column:
    return F.size(x).cast("double")


def token_overlap(left: Column, right: Column, prefix: str) -> list[Column]:
    """Jaccard similarity, count, and share of either side's distinct tokens that are common."""
    a, b = tokens(left), tokens(right)
    return set_overlap(F.size(a), F.size(b), F.size(F.array_intersect(a, b)), prefix)


def set_overlap(left: Column, right: Column, common: Column, prefix: str) -> list[Column]:
    """token_overlap() of the sizes of two sets and of what they have in common."""
    left, right, common = (x.cast("double") for x in (left, right, common))
    union = left + right - common
    return [
        F.when(union == 0, 0.0).otherwise(common / union).alias(f"{prefix}_jaccard"),
        common.alias(f"{prefix}_token_overlap"),
        (common / F.greatest(left, F.lit(1.0))).alias(f"{prefix}_token_overlap_frac_s1"),
        (common / F.greatest(right, F.lit(1.0))).alias(f"{prefix}_token_overlap_frac_cand"),
    ]


def number_overlap(left: Column, right: Column) -> list[Column]:
    """Of the numbers of two addresses: Jaccard similarity, common count, both present, and present but disjoint."""
    a, b = tokens(left), tokens(right)
    common, union = _size(F.array_intersect(a, b)), _size(F.array_union(a, b))
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return [
        F.when(union == 0, 0.0).otherwise(common / union).alias("addr_num_jaccard"),
        common.alias("addr_num_overlap"),
        both.cast("double").alias("addr_num_both_present"),
        (both & (common == 0)).cast("double").alias("addr_num_conflict"),
    ]


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
