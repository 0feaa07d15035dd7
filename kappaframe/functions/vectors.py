"""Vector columns: class distributions of known width are unrolled into plain arithmetic (whole-stage
code generation), embeddings use array functions row by row and numpy blocks for comparisons."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(vector: Column, width: int) -> list[Column]:
    return [vector[i].cast("double") for i in range(width)]


def softmax(logits: Column, width: int) -> Column:
    """Probabilities of `width` logits."""
    parts = _parts(logits, width)
    top = F.greatest(*parts) if width > 1 else parts[0]
    exps = [F.exp(p - top) for p in parts]
    total = reduce(add, exps)
    return F.array(*[e / total for e in exps])


def argmax(vector: Column) -> Column:
    """0-based position of the first largest element."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def expectation(distribution: Column, values: list[float]) -> Column:
    return reduce(add, [distribution[i].cast("double") * F.lit(float(v)) for i, v in enumerate(values)])


def rounded(vector: Column, digits: int = 3) -> Column:
    return F.transform(vector, lambda x: F.bround(x, digits))


def parse_vector(text: Column) -> Column:
    """`[0.1 0.2, 0.7]` as printed by array libraries to ARRAY<DOUBLE>."""
    inside = F.trim(F.regexp_replace(text, "[\\[\\],\\s]+", " "))
    return F.transform(F.split(inside, " "), lambda x: x.cast("double"))


def cross_entropy(distribution: Column, label: Column) -> Column:
    """`-log p[label]` with a 0-based label."""
    return -F.log(distribution[label].cast("double"))


def ordinal_log_loss(distribution: Column, label: Column, width: int) -> Column:
    """`-sum_k log(1 - p_k) |label - k|^2`, the term of the label itself being zero."""
    terms = [
        F.when(label != k, -F.log(1.0 - distribution[k].cast("double")) * F.pow(label - k, F.lit(2.0))).otherwise(0.0)
        for k in range(width)
    ]
    return reduce(add, terms)


def squared_error(distribution: Column, label: Column, width: int) -> Column:
    """Squared distance of the expected class from the label."""
    return F.pow(expectation(distribution, list(range(width))) - label, 2.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / norm(v))


def cosine(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """Cosine similarity; the product of the norms is kept at `eps` or above."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))
