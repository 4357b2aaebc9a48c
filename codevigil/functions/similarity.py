"""Similarity measures and the confidence formulas built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ..common import r2


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard of two arrays without repeats: 1 when both are empty, 0 when one is."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def jaccard_of_counts(shared: Column, left_size: Column, right_size: Column) -> Column:
    union = left_size + right_size - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def norm2(features: Column) -> Column:
    """Sum of squares of a count map."""
    return F.aggregate(F.map_values(features), F.lit(0.0), lambda acc, v: acc + v * v)


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.map_entries(left),
        F.lit(0.0),
        lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(right, e["key"]), F.lit(0.0)),
    )


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two sparse count maps; 0 when one is empty."""
    norms = F.sqrt(norm2(left)) * F.sqrt(norm2(right))
    return F.when(norms > 0, dot(left, right) / norms).otherwise(F.lit(0.0))


def count_similarity(left: Column, right: Column) -> Column:
    """1 - |a-b| / max(a, b, 1)."""
    return F.lit(1.0) - F.abs(left - right) / F.greatest(left, right, F.lit(1))


def signature_similarity(params_l: Column, params_r: Column, token_jaccard: Column) -> Column:
    return F.lit(0.6) * count_similarity(params_l, params_r) + F.lit(0.4) * token_jaccard


def class_api_similarity(api: Column, member: Column, members_l: Column, members_r: Column) -> Column:
    return F.lit(0.45) * api + F.lit(0.35) * member + F.lit(0.2) * count_similarity(members_l, members_r)


def module_shape_similarity(shape: Column, symbols_l: Column, symbols_r: Column) -> Column:
    return F.lit(0.7) * shape + F.lit(0.3) * count_similarity(symbols_l, symbols_r)


def _over(value: Column, floor: float) -> Column:
    return F.greatest(value - F.lit(floor), F.lit(0.0))


def function_confidence(name: Column, signature: Column, shape: Column) -> Column:
    raw = (
        F.lit(fixed.MIN_CONFIDENCE)
        + _over(shape, fixed.MIN_SHAPE) * 0.45
        + _over(signature, fixed.MIN_SIGNATURE) * 0.2
        + _over(name, fixed.MIN_NAME_OVERLAP) * 0.2
    )
    return r2(F.least(raw, F.lit(0.97)))


def class_confidence(name: Column, api: Column, shape: Column) -> Column:
    raw = (
        F.lit(fixed.MIN_CONFIDENCE)
        + _over(shape, fixed.MIN_SHAPE) * 0.4
        + _over(api, fixed.MIN_SIGNATURE) * 0.25
        + _over(name, fixed.MIN_NAME_OVERLAP) * 0.2
    )
    return r2(F.least(raw, F.lit(0.97)))


def cleanup_confidence(path_hits: Column, content_hits: Column) -> Column:
    """0.55 plus 0.12 per path hit and 0.18 per content hit, between 0.55 and 0.95 (summed in hundredths)."""
    points = F.lit(55) + path_hits * 12 + content_hits * 18
    return F.least(F.greatest(points, F.lit(55)), F.lit(95)) / F.lit(100.0)
