"""Functions of vectors, sets and probabilities as Column expressions: no Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: str, b: str) -> str:
    """SQL of the inner product of two array columns, in double precision."""
    return f"aggregate(zip_with({a}, {b}, (x_, y_) -> cast(x_ as double) * cast(y_ as double)), 0D, (s_, x_) -> s_ + x_)"


def normalised(v: str) -> Column:
    """A vector at length 1; a zero vector stays as it is."""
    size = f"sqrt({dot(v, v)})"
    return F.expr(f"transform(array({size}), n_ -> transform({v}, x_ -> CASE WHEN n_ > 0 THEN cast(x_ as double) / n_ ELSE cast(x_ as double) END))[0]")


def truncated(v: str, n: int) -> Column:
    """The first n components at length 1 (embeddings trained so that they mean something alone)."""
    part = f"slice({v}, 1, {n})"
    return F.expr(f"transform(array(sqrt({dot(part, part)})), n_ -> transform({part}, x_ -> CASE WHEN n_ > 0 THEN cast(x_ as double) / n_ ELSE cast(x_ as double) END))[0]")


def mean_pooled(tokens: str, mask: str) -> Column:
    """The mean of the token vectors (array of arrays) whose mask is 1; zeros if none is."""
    total = f"aggregate(zip_with({tokens}, {mask}, (t_, m_) -> transform(t_, x_ -> cast(x_ as double) * m_)), transform({tokens}[0], x_ -> 0D), (s_, t_) -> zip_with(s_, t_, (x_, y_) -> x_ + y_))"
    return F.expr(f"transform({total}, x_ -> x_ / greatest(aggregate({mask}, 0D, (s_, m_) -> s_ + m_), 1D))")


def from_blob(blob: str) -> Column:
    """A vector out of little-endian 4-byte floats; null if the length is no multiple of 4.

    IEEE 754 by hand: sign, exponent and fraction of each group of four bytes.
    """
    byte = "cast(conv(hex(substring({0}, 4 * i_ + {1}, 1)), 16, 10) as bigint)"
    bits = " | ".join(f"shiftleft({byte.format(blob, k + 1)}, {8 * k})" for k in range(4))
    value = (
        "CASE WHEN (shiftright(b_, 23) & 255) = 0 THEN (b_ & 8388607) * pow(2D, -149) "
        "ELSE (1 + (b_ & 8388607) / 8388608D) * pow(2D, (shiftright(b_, 23) & 255) - 127) END * (CASE WHEN (shiftright(b_, 31) & 1) = 1 THEN -1D ELSE 1D END)"
    )
    places = f"CASE WHEN octet_length({blob}) = 0 THEN cast(array() as array<int>) ELSE sequence(0, cast(octet_length({blob}) / 4 as int) - 1) END"
    return F.expr(f"CASE WHEN octet_length({blob}) % 4 = 0 THEN transform(transform({places}, i_ -> ({bits})), b_ -> cast({value} as float)) END")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(logits: str) -> Column:
    """Probabilities of logits; the greatest is taken off first, so that nothing overflows."""
    shifted = f"transform({logits}, x_ -> exp(cast(x_ as double) - array_max({logits})))"
    return F.expr(f"transform(array({shifted}), e_ -> transform(e_, x_ -> x_ / aggregate(e_, 0D, (s_, y_) -> s_ + y_)))[0]")


def best_span(starts: str, ends: str, longest: int = 128) -> Column:
    """(score, first, last) of the places first <= last, less than `longest` apart, with the greatest sum of start and end logits; ties by the earliest."""
    pairs = (
        f"flatten(transform(sequence(0, size({starts}) - 1), i_ -> transform(sequence(i_, least(size({ends}) - 1, i_ + {longest - 1})), "
        f"j_ -> struct(cast({starts}[i_] + {ends}[j_] as double) as score, -i_ as a, -j_ as b))))"
    )
    return F.expr(f"CASE WHEN size({starts}) > 0 THEN transform(array(array_max({pairs})), p_ -> struct(p_.score as score, -p_.a as first, -p_.b as last))[0] END")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
