"""Array maths on logits and score lists, written as SQL higher-order functions.

A value computed from an array and then used inside a lambda over the same
array would be inlined by Catalyst and recomputed for every element.  Values
needed inside a lambda are therefore bound once with the one-element
``transform(array(v), v -> ...)[0]`` form (a "let").
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slice0(arr: str | Column, start: int, length: int) -> Column:
    """Elements ``start .. start+length-1`` (0-based) as doubles."""
    return F.slice(_c(arr), start + 1, length).cast("array<double>")


def argmax(arr: str | Column) -> Column:
    """0-based index of the largest element; ties go to the first (numpy rule)."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def let(value: Column, body) -> Column:
    """Bind ``value`` once and evaluate ``body(value)``."""
    return F.transform(F.array(value), body)[0]


def logsumexp(arr: str | Column) -> Column:
    """``max + ln(sum(exp(x - max)))`` with the max bound once."""
    a = _c(arr)
    return let(F.array_max(a), lambda m: m + F.log(
        F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))))


def softmax(arr: str | Column, scale: float = 1.0) -> Column:
    """``exp(s*x - max) / sum``; the scaled array, max, exponentials and sum
    are each bound once per row."""
    return let(F.transform(_c(arr), lambda x: x * F.lit(float(scale))), lambda a: let(
        F.array_max(a), lambda m: let(
            F.transform(a, lambda x: F.exp(x - m)), lambda e: let(
                F.aggregate(e, F.lit(0.0), lambda s, y: s + y),
                lambda total: F.transform(e, lambda v: v / total)))))


def nll(arr: str | Column, label: str | Column) -> Column:
    """Cross-entropy of one row: ``logsumexp(logits) - logits[label]``."""
    a = _c(arr)
    return logsumexp(a) - F.element_at(a, _c(label).cast("int") + 1)
