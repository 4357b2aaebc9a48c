"""Whole reviews, composed from the operators: concern table, enrichment, display and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.contracts import contract_concerns, contract_violations
from ..operators.duplicates import near_duplicates
from ..operators.enrich import enrich_risk
from ..operators.ranking import rank_concerns, scope_display, signals
from ..operators.review import build_concerns
from ..operators.similarity import shadow_concerns, shadow_pairs
from ..session import materialise


def incremental_review(
    functions: DataFrame,
    symbols: DataFrame,
    imports: DataFrame,
    rules: DataFrame,
    changes: DataFrame,
    risk: DataFrame,
    limit: int = 5,
) -> dict[str, DataFrame]:
    """Review of a change set: scoped duplicates, shadows and contracts, with risk facts.

    Returns ``concerns`` (all, stored once), ``display`` (ranked) and ``signals``.
    """
    sources = [
        near_duplicates(functions, changes),
        shadow_concerns(shadow_pairs(symbols, changes)),
        contract_concerns(contract_violations(imports, rules, changes)),
    ]
    concerns = materialise(enrich_risk(build_concerns(*sources), risk), "concerns")
    shown = scope_display(concerns, changes).where(F.col("shown"))
    return {"concerns": concerns, "display": rank_concerns(shown, limit), "signals": signals(concerns)}
