"""Expressions over per-row probability arrays ordered by a sorted class list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_LOGIT = -50.0  # fixed value: score of a class a fold model never saw


def class_array(classes: list[str]) -> Column:
    return F.array(*[F.lit(c) for c in classes])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def probability_to_logits(p: Column, epsilon: float = 1e-12) -> Column:
    return F.transform(p, lambda x: F.ln(F.least(F.greatest(x.cast("double"), F.lit(epsilon)), F.lit(1.0))))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``, also from inside an element lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Max-shifted softmax of ``logits / temperature``; linear in the number of classes."""
    scale = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    shifted = bind(
        F.struct(logits.alias("z"), F.array_max(logits).alias("top")),
        lambda a: F.transform(a["z"], lambda x: F.exp((x - a["top"]) / scale)),
    )
    return bind(
        shifted,
        lambda e: bind(
            F.struct(e.alias("e"), total(e).alias("t")), lambda b: F.transform(b["e"], lambda x: x / b["t"])
        ),
    )


def align_scores(scores: Column, local: Column, classes: Column) -> Column:
    """Reorder scores of ``local`` classes to ``classes``; absent classes get a very low score."""
    at = lambda c: F.array_position(local, c).cast("int")
    return F.transform(
        classes, lambda c: F.when(at(c) > 0, F.get(scores, at(c) - 1)).otherwise(F.lit(MISSING_LOGIT))
    )


def argmax_index(values: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def argmax_label(values: Column, classes: Column) -> Column:
    return F.get(classes, argmax_index(values))


def ranked_positions(values: Column) -> Column:
    """Class positions by descending value; equal values keep class order."""
    tagged = F.transform(values, lambda x, i: F.struct((-x.cast("double")).alias("s"), i.alias("i")))
    return F.transform(F.array_sort(tagged), lambda t: t["i"])


def top_labels(values: Column, classes: Column, k: int = 3) -> Column:
    return F.transform(F.slice(ranked_positions(values), 1, k), lambda i: F.get(classes, i))


def runner_up(values: Column, classes: Column) -> tuple[Column, Column, Column]:
    """(label, score, margin) of the second place; label is empty when there is one class."""
    order = ranked_positions(values)
    second = F.get(order, F.lit(1))
    best = F.array_max(values).cast("double")
    score = F.get(values, second).cast("double")
    return F.coalesce(F.get(classes, second), F.lit("")), score, best - score


def value_at_label(values: Column, classes: Column, label: Column) -> Column:
    at = F.array_position(classes, label).cast("int")
    return F.when(at > 0, F.get(values, at - 1).cast("double"))


def brier(values: Column, classes: Column, label: Column) -> Column:
    """Sum of (p - target)^2, expanded so that one pass over the array is enough."""
    squares = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return squares - F.lit(2.0) * value_at_label(values, classes, label) + F.lit(1.0)


def prediction_set(values: Column, classes: Column, thresholds: Column) -> Column:
    """Labels with ``1 - p <= threshold``, in class order."""
    inside = lambda i: (F.lit(1.0) - F.get(values, i).cast("double")) <= F.get(thresholds, i)
    return F.filter(classes, lambda label, i: inside(i))


def only_member(labels: Column) -> Column:
    return F.when(F.size(labels) == 1, F.get(labels, F.lit(0)))


def grouped_sum(values: Column, group_of_class: list[str], groups: list[str]) -> Column:
    """Sum class values into parent groups, in double precision; a flat sum, so it stays in generated code."""
    def members(group: str) -> Column:
        parts = [F.get(values, F.lit(i)).cast("double") for i, g in enumerate(group_of_class) if g == group]
        return reduce(lambda a, b: a + b, parts, F.lit(0.0))

    return F.array(*[members(group) for group in groups])


def is_distribution(p: Column, tolerance: float = 1e-6) -> Column:
    """Finite, within [0, 1] and summing to one."""
    bad = F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))
    return ~bad & (F.abs(total(p) - 1.0) <= tolerance)


def sorted_json(values: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(values)))


def parse_label_set(text: Column) -> Column:
    """A JSON list of distinct strings; NULL for anything else."""
    parsed = F.from_json(text, "array<string>")
    json_like = F.trim(text).rlike(r'^\[\s*(?:"(?:[^"\\]|\\.)*"\s*(?:,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]$')
    return F.when(json_like & (F.size(F.array_distinct(parsed)) == F.size(parsed)), parsed)
