"""Stable identifiers and evidence lookup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_digest(payload: Column) -> Column:
    """First 12 hex digits of the sha256 of a text."""
    return F.substring(F.sha2(payload, 256), 1, 12)


def stable_id(kind: Column | str, *parts: Column) -> Column:
    """``code-review:<kind>:<digest>`` of the parts joined by '|'."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in (kind, *parts)])
    return F.concat(F.lit("code-review:"), kind, F.lit(":"), short_digest(text))


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def review_concern_id(kind: Column, source: Column, location: Column, evidence: Column) -> Column:
    """Identifier of a review concern from its kind, source, location and sorted evidence."""
    place = F.struct(*[location[k].alias(k) for k in ("line", "path", "symbol", "symbol_kind")])
    payload = canonical_json(kind=kind, source=source, location=place, evidence=F.array_sort(evidence))
    return F.concat(F.lit("code-review:"), kind, F.lit(":"), short_digest(payload))


def evidence_value(evidence: Column, key: str) -> Column:
    """Text after ``key=`` in the first evidence entry that starts so; empty when there is none."""
    prefix = key + "="
    found = F.filter(evidence, lambda e: e.startswith(prefix))
    return F.coalesce(F.substring(F.get(found, F.lit(0)), len(prefix) + 1, 2**31 - 1), F.lit(""))


def has_evidence(evidence: Column, prefix: str) -> Column:
    return F.exists(evidence, lambda e: e.startswith(prefix))
