"""Session-level folds over requests and fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def service_tier_summary(requests: DataFrame, key: list[str]) -> DataFrame:
    """Tier of a session: its one tier, 'mixed' for several, else its speed."""
    def values(column: str):
        return F.array_sort(F.collect_set(F.nullif(F.lower(F.trim(column)), F.lit(""))))

    def one(column: str):
        return F.when(F.size(column) == 1, F.get(column, F.lit(0))).when(F.size(column) > 1, "mixed")

    rows = requests.groupBy(*key).agg(values("service_tier").alias("_tiers"), values("speed").alias("_speeds"))
    detail = F.when(F.size("_tiers") > 0, F.concat(F.lit("usage.service_tier: "), F.array_join("_tiers", ", "))).when(
        F.size("_speeds") > 0, F.concat(F.lit("usage.speed: "), F.array_join("_speeds", ", "))
    )
    return rows.select(*key, F.coalesce(one("_tiers"), one("_speeds")).alias("service_tier"), detail.alias("detail"))


def cost_warnings(source: str, priceable: Column) -> Column:
    """Warnings of a session with those of its price. Needs warnings, cost_micro,
    price_warnings and price_assumptions; ``priceable`` tells whether it has a token split.
    """
    none = F.array().cast("array<string>")
    own, found, assumed = (F.coalesce(c, none) for c in ("warnings", "price_warnings", "price_assumptions"))
    unpriced = {
        "codex": F.when(priceable, F.array(F.lit("unknown_pricing"))).otherwise(F.array(F.lit("missing_token_breakdown"))),
        "claude": F.array(F.lit("unknown_pricing")),
        "copilot": F.when(priceable, F.array(F.lit("unknown_pricing"))).otherwise(none),
        "cursor": F.when(F.coalesce("estimated", F.lit(False)), F.array(F.lit("cursor_cost_not_estimated_from_prompt_tokens")))
        .when(priceable, F.array(F.lit("unknown_pricing"))).otherwise(F.array(F.lit("unknown_cost"))) if source == "cursor" else none,
    }[source]
    fast = F.when(
        F.exists(found, lambda w: w.startswith("unknown_pricing_model:") & w.contains("fast-mode")), F.array(F.lit("unknown_fast_mode_pricing"))
    ).otherwise(none) if source == "claude" else none
    return F.array_distinct(F.when(F.col("cost_micro").isNull(), F.concat(own, unpriced, found, assumed, fast)).otherwise(F.concat(own, assumed)))
