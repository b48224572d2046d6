"""Expressions over vectors of the seven classes."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from vulnspark.functions.text import let
from vulnspark.taxonomy import LABELS, NUM_LABELS


def _cells(vector: Column) -> list[Column]:
    return [vector[i] for i in range(NUM_LABELS)]


def argmax(vector: Column) -> Column:
    """Class id of the greatest entry; the first one on ties."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Class probabilities at a temperature (floored at 1e-6).

    Kept a small expression: filters on the outcome are pushed below it and repeat it.
    """
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    floor = F.greatest(t, F.lit(1e-6))

    def weights(scaled: Column) -> Column:
        return let(F.array_max(scaled), lambda top: F.transform(scaled, lambda x: F.exp(x - top)))

    def shares(w: Column) -> Column:
        total = F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x)
        return let(total, lambda z: F.transform(w, lambda x: x / z))

    return let(let(F.transform(logits, lambda x: x / floor), weights), shares)


def cross_entropy(logits: Column, label: Column, temperature: Column) -> Column:
    """Negative log-likelihood of the true class at a temperature. Unrolled, so that a pass
    over many temperatures stays in generated code."""
    scaled = [x / temperature for x in _cells(logits)]
    top = F.greatest(*scaled)
    mass = reduce(add, [F.exp(x - top) for x in scaled])
    return F.log(mass) + top - F.get(logits, label) / temperature


def one_hot(label: Column) -> Column:
    """Hard class ids as score vectors, so that rule tools share the metric code."""
    return F.array(*[F.when(label == i, 1.0).otherwise(0.0) for i in range(NUM_LABELS)])


def vulnerable_mass(probs: Column) -> Column:
    return reduce(add, _cells(probs)[1:])


def class_map(probs: Column, digits: int | None = None) -> Column:
    """Class name to probability, rounded when `digits` is given."""
    cells = _cells(probs)
    if digits is not None:
        cells = [F.round(x, digits) for x in cells]
    return F.map_from_arrays(F.array(*map(F.lit, LABELS)), F.array(*cells))
