"""Rate cards, model resolution, tiers and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.functions import models as M
from tokentally.operators import pricing
from tokentally.plans.binding import Tables
from tokentally.plans.oracle import BUCKETS, norm_model, tier_sql, version_sql
from tokentally.plans.registry import query

USD = "CAST({} AS DOUBLE) / 1000000.0"


@query("pricing_model_id", f"SELECT model, {norm_model('model')} AS model_id, count(*) AS requests FROM tt_requests GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return t.requests.groupBy("model").agg(F.count("*").alias("requests")).select("model", M.pricing_model_id(F.col("model")).alias("model_id"), "requests")


@query("parse_model_version", f"""
SELECT model, {tier_sql('model_id')} AS tier, {version_sql('model_id')} AS version, count(*) AS requests
FROM (SELECT model, {norm_model('model')} AS model_id FROM tt_requests) GROUP BY 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    ids = t.requests.groupBy("model").agg(F.count("*").alias("requests")).withColumn("model_id", M.pricing_model_id(F.col("model")))
    return ids.select("model", M.model_tier(F.col("model_id")).alias("tier"), M.model_version(F.col("model_id")).alias("version"), "requests")


@query("resolve_rate_card", """
SELECT r.model, r.source_model, r.inherited, r.priced, count(*) AS requests
FROM tt_resolved r JOIN tt_requests q ON q.model = r.model GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    used = t.requests.where("model is not null").groupBy("model").agg(F.count("*").alias("requests"))
    return used.join(pricing.resolve_models(used, t.cards), "model").select("model", "source_model", "inherited", "priced", "requests")


@query("request_context_tier", """
SELECT session_id, ord, source_model, long_context, price_warning, price_assumption FROM tt_priced""")
def _(t: Tables) -> DataFrame:
    return pricing.price_requests(t.requests, t.cards, t.requests).select("session_id", "ord", "source_model", "long_context", "price_warning", "price_assumption")


@query("request_cost", """
SELECT session_id, ord, model, CAST((cost_pico + 500000) // 1000000 AS DOUBLE) / 1000000.0 AS cost_usd FROM tt_priced""")
def _(t: Tables) -> DataFrame:
    priced = pricing.price_requests(t.requests, t.cards, t.requests)
    return priced.select("session_id", "ord", "model", pricing.micro_to_usd(pricing.pico_to_micro(F.col("cost_pico"))).alias("cost_usd"))


@query("session_model_usage", f"""
SELECT session_id, model, request_count, {', '.join(BUCKETS)}, {USD.format('cost_micro')} AS cost_usd FROM tt_slices""")
def _(t: Tables) -> DataFrame:
    return t.slices.select("session_id", "model", "request_count", *BUCKETS, pricing.micro_to_usd(F.col("cost_micro")).alias("cost_usd"))


@query("session_cost", f"""
SELECT session_id, request_count, first_model AS model, total_tokens, {USD.format('cost_micro')} AS cost_usd,
  array_to_string(list_sort(coalesce(price_warnings, [])), ';') AS price_warnings,
  array_to_string(list_sort(coalesce(price_assumptions, [])), ';') AS price_assumptions
FROM tt_costs""")
def _(t: Tables) -> DataFrame:
    return t.costs.select(
        "session_id", "request_count", F.col("first_model").alias("model"), "total_tokens",
        pricing.micro_to_usd(F.col("cost_micro")).alias("cost_usd"),
        F.array_join("price_warnings", ";").alias("price_warnings"), F.array_join("price_assumptions", ";").alias("price_assumptions"),
    )
