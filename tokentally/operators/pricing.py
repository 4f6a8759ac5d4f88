"""Rate-card resolution and cost.

Money is exact: rates are whole micro-USD per million tokens, so tokens x rate
is a whole number of pico-USD. Costs are summed unrounded and rounded once, to
whole micro-USD, per session or slice.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokentally import rates
from tokentally.functions import models as M
from tokentally.runtime import BROADCAST_ROW_LIMIT, local_table

BUCKETS = [
    "input_tokens", "cached_input_tokens", "cache_write_tokens", "cache_write_5m", "cache_write_1h",
    "cache_write_30m", "cache_write_12h", "output_tokens", "reasoning_tokens", "total_tokens",
]
BILLED = ["fresh", "cached", "write_5m", "write_1h", "write_30m", "write_12h", "write", "output", "reasoning"]
# Buckets billed as they are counted.
SAME = {
    "cached": "cached_input_tokens", "write_5m": "cache_write_5m", "write_1h": "cache_write_1h", "write_30m": "cache_write_30m",
    "write_12h": "cache_write_12h", "output": "output_tokens", "reasoning": "reasoning_tokens",
}
HAIKU = "claude-haiku-5-5"
THRESHOLDS = sorted({r[1] for r in rates.context_rules()})


# ---------------------------------------------------------------- rate cards

def usable_card(prefix: str = "") -> Column:
    return F.coalesce((F.col(prefix + "input") > 0) & (F.col(prefix + "output") > 0), F.lit(False))


def load_cards(bundled: DataFrame, saved: DataFrame) -> DataFrame:
    """Bundled cards overlaid by saved rows.

    A saved file that still holds the whole old table is first reduced to the
    rows its user changed.
    """
    saved = drop_stale_saved_rows(bundled, saved)
    kept = bundled.join(saved.select("model"), "model", "left_anti")
    return kept.unionByName(saved)


def _same_rates(left: str, right: str) -> Column:
    tests = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in rates.RATE_COLUMNS]
    return reduce(lambda a, b: a & b, tests)


def changed_cards(cards: DataFrame, bundled: DataFrame) -> DataFrame:
    """Cards that are not bundled, or whose rates differ from the bundled ones."""
    same = cards.alias("c").join(bundled.alias("b"), F.col("c.model") == F.col("b.model")).where(_same_rates("c", "b"))
    return cards.join(same.select("c.model"), "model", "left_anti")


def drop_stale_saved_rows(bundled: DataFrame, saved: DataFrame) -> DataFrame:
    spark = saved.sparkSession
    old_ids = local_table(spark, [(m,) for m in rates.OLD_FULL_TABLE_MODELS], T.StructType([T.StructField("model", T.StringType())]))
    rows = [tuple(c[f.name] for f in rates.CARD_SCHEMA.fields) for c in rates.old_bundled_cards()]
    old_rates = local_table(spark, rows, rates.CARD_SCHEMA)
    # One row: does the saved table hold every id of the old full table?
    is_full = old_ids.join(saved, "model", "left_anti").agg((F.count("*") == 0).alias("full")).scalar()
    user_rows = changed_cards(changed_cards(saved, old_rates), bundled)
    stale = saved.join(user_rows.select("model"), "model", "left_anti").select("model", F.lit(True).alias("stale"))
    return (
        saved.join(stale, "model", "left")
        .where(~(is_full & F.coalesce("stale", F.lit(False))))
        .select(saved.columns)
    )


def _micro(c: Column) -> Column:
    return (c * 1_000_000).cast("decimal(18,0)")


def _effective_rates() -> Column:
    """Rates a usable card bills each bucket at, after its fallbacks."""

    def first_positive(*names: str) -> Column:
        return F.coalesce(*[F.when(F.col(n) > 0, F.col(n)) for n in names], F.lit(0).cast("decimal(12,6)"))

    picked = {
        "fresh": F.col("input"),
        "cached": F.coalesce("cached", "input"),
        "write_5m": first_positive("write_5m", "write", "input"),
        "write_1h": first_positive("write_1h", "write", "input"),
        "write_30m": first_positive("write_30m", "write", "input"),
        "write_12h": first_positive("write_12h", "write", "input"),
        "write": first_positive("write", "write_1h", "write_5m", "input"),
        "output": F.col("output"),
        "reasoning": F.coalesce("reasoning", "output"),
    }
    return F.struct(*[_micro(picked[b]).alias(b) for b in BILLED])


def _literal(rows: list[dict], schema: str) -> Column:
    """Fixed rows as one constant array."""
    return F.from_json(F.lit(json.dumps(rows, default=str)), f"array<{schema}>")


def card_table(cards: DataFrame) -> DataFrame:
    """Each card with its normal id, version line, the rates it bills at, its request-size rule, and Haiku's rule, which later Haiku models inherit.

    The cards are put into one row and taken out again, so that each can look at the others; more than
    BROADCAST_ROW_LIMIT are an error, so that what is broadcast of a rate card has a bound.
    """
    bundled = _literal([{k: c[k] for k in ("model", *rates.RATE_COLUMNS)} for c in rates.bundled_cards()], "struct<model: string, " + ", ".join(f"{c}: decimal(12,6)" for c in rates.RATE_COLUMNS) + ">")
    listed = _literal([dict(zip(rates.RULE_SCHEMA.names, r)) for r in rates.context_rules()], rates.RULE_SCHEMA.simpleString())
    same = " AND ".join(f"b.{c} <=> c.{c}" for c in ("model", *rates.RATE_COLUMNS))
    named = cards.select("model", *rates.RATE_COLUMNS, "position", usable_card().alias("usable"), F.when(usable_card(), _effective_rates()).alias("rates"), M.pricing_model_id(F.col("model")).alias("model_id"))
    lined = named.withColumn("line", M.line_and_version(F.col("model_id")))
    raw = F.when(F.count("*") <= BROADCAST_ROW_LIMIT, F.collect_list(F.struct(*lined.columns))).otherwise(F.raise_error(F.lit("too many rate cards")))
    one = lined.agg(raw.alias("raw")).withColumns({"bundled": bundled, "listed": listed})
    one = one.withColumn("custom", F.expr(f"transform(filter(raw, c -> NOT exists(bundled, b -> {same})), c -> c.model)"))
    # A base card its user re-priced stays flat while the long card is untouched.
    flat = "r.flat_override AND array_contains(custom, r.base_model) AND NOT array_contains(custom, r.long_model) AND exists(raw, c -> c.model = r.long_model)"

    def rates_of(model: str) -> str:
        return f"get(filter(raw, c -> c.model = r.{model}), 0).rates"

    rules = f"""transform(listed, r -> struct(r.base_model, if({flat}, NULL, r.threshold) AS threshold, r.long_model, r.unknown_size, r.missing_long,
        {rates_of('base_model')} AS rule_rates, {rates_of('long_model')} AS long_rates))"""
    ruled = one.withColumn("rules", F.expr(rules)).selectExpr("rules", f"get(filter(rules, r -> r.base_model = '{HAIKU}'), 0) AS haiku", "explode(raw) AS c")
    return ruled.selectExpr("c.model AS card", "c.model_id", "c.line", "c.usable", "c.position", "c.rates", "get(filter(rules, r -> r.base_model = c.model), 0) AS rule", "haiku")


def with_rates(df: DataFrame, cards: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Rows with ``_r``: what their model is billed by, in the plan of the query that asks.

    Order: the id itself, its normal form, the newest older version of the same line, a
    Claude family, a Copilot family. Unusable cards are passed over.

    ``ids`` is a table whose column model holds the ids in use, for callers that can read it at
    little cost: they are resolved once each and broadcast, and more than BROADCAST_ROW_LIMIT are an error
    that asks for the way without. Without ``ids``, each row is resolved where it is.
    """
    if ids is None:
        return _rates_by_row(df, cards)
    few = ids.select("model").where("model is not null").distinct().limit(BROADCAST_ROW_LIMIT + 1)
    listed = F.when(F.count("*") <= BROADCAST_ROW_LIMIT, F.collect_list("model")).otherwise(F.raise_error(F.lit("too many model ids: leave out ids")))
    counted = few.agg(listed.alias("models")).select(F.explode("models").alias("model"))
    known = _rates_by_row(counted, cards).withColumnRenamed("model", "_m")
    return df.join(F.broadcast(known), F.col("model") == F.col("_m"), "left").drop("_m")


def _rates_by_row(df: DataFrame, cards: DataFrame) -> DataFrame:
    """Rows with ``_r``. The normal form and all later steps are only worked out for ids that no
    usable card spells the same way; they look at the names of the cards that share the id's first part.
    Rates are met last, by the card that was found.
    """
    table, model = card_table(cards), F.col("model")
    direct = df.join(F.broadcast(table.select(F.col("card").alias("_n1"), F.col("usable").alias("_u1"))), model == F.col("_n1"), "left")
    named = direct.withColumn("_id", F.when(model.isNotNull() & ~F.coalesce("_u1", F.lit(False)), M.pricing_model_id(model)))
    heads = table.withColumn("_head", F.explode(M.heads(F.col("card"), F.col("model_id")))).groupBy("_head").agg(F.collect_list(F.struct("card", "usable", "line", "position")).alias("_cards"))
    headed = named.withColumn("_h", M.head(F.col("_id"))).join(F.broadcast(heads), F.col("_h") == F.col("_head"), "left")
    # A name that exists is the exact card even when it is unusable.
    normal = headed.withColumn("_e", F.when(F.col("_n1").isNotNull(), F.struct(F.col("_n1").alias("card"), F.col("_u1").alias("usable"))).otherwise(F.expr("get(transform(filter(_cards, x -> x.card = _id), x -> struct(x.card, x.usable)), 0)")))
    sound = F.coalesce(F.col("_e.usable"), F.lit(False))
    open_id = F.col("_cards").isNotNull() & ~sound
    told = normal.withColumns({"_line": F.when(open_id, M.line_and_version(F.col("_id"))), "_families": F.when(open_id, F.expr(M.family_candidates("_id")))})
    newest = F.expr("array_min(transform(filter(_cards, x -> x.usable AND x.line.tier = _line.tier AND x.line.version <= _line.version), x -> struct(-x.line.version AS v, x.position AS p, x.card AS card))).card")
    family = F.expr("array_min(filter(transform(_cards, x -> struct(if(x.usable, get(filter(_families, f -> f.card = x.card), 0).priority, NULL) AS v, x.card AS card)), o -> o.v IS NOT NULL)).card")
    found = told.withColumn("_found", F.when(sound, F.col("_e.card")).when(F.col("_families").isNotNull(), F.coalesce(newest, family)))
    inherited = F.coalesce(~sound & (F.col("_found") != model) & (F.col("_found") != F.col("_id")), F.lit(False))
    as_haiku = F.coalesce(inherited & M.is_family(F.col("_id"), HAIKU), F.lit(False))
    known = found.select(*df.columns, F.coalesce("_found", "_e.card").alias("_card"), F.col("_found").isNotNull().alias("_priced"), inherited.alias("_inherited"), as_haiku.alias("_as_haiku"))
    met = known.join(F.broadcast(table.select(F.col("card").alias("_n3"), "rates", "rule", "haiku").withColumnsRenamed({"rates": "_own", "rule": "_own_rule", "haiku": "_haiku"})), F.col("_card") == F.col("_n3"), "left")
    ruled = met.withColumn("_rule", F.when(F.col("_as_haiku"), F.col("_haiku")).otherwise(F.col("_own_rule")))
    rule = F.col("_rule")
    base = F.when(F.col("_as_haiku"), HAIKU).otherwise(F.col("_card"))
    billed = F.struct(
        F.col("_card").alias("source_model"), F.col("_inherited").alias("inherited"), F.col("_priced").alias("priced"), rule.isNotNull().alias("tiered"), base.alias("base_model"),
        *[rule[n].alias(n) for n in ("threshold", "long_model", "unknown_size", "missing_long", "long_rates")],
        F.when(rule.isNotNull() & (base != F.col("_card")), rule["rule_rates"]).otherwise(F.col("_own")).alias("base_rates"),
    )
    return ruled.select(*df.columns, billed.alias("_r"))


def resolve_models(models: DataFrame, cards: DataFrame) -> DataFrame:
    """One row per model id: the card it is billed by and how it was found."""
    ids = models.select("model").where("model is not null").distinct()
    return with_rates(ids, cards).select("model", M.pricing_model_id(F.col("model")).alias("model_id"), "_r.source_model", "_r.inherited", "_r.priced", "_r.base_rates")


# ---------------------------------------------------------------- request cost

def size_class(size: Column) -> Column:
    """-1 when the request size is unknown, else how many tier thresholds it exceeds."""
    over = reduce(lambda a, b: a + b, [F.when(size > t, 1).otherwise(0) for t in THRESHOLDS])
    return F.when(size.isNull() | (size < 0), F.lit(-1)).otherwise(over)


def _threshold_class(threshold: Column) -> Column:
    out = F.lit(None).cast("int")
    for rank, value in enumerate(THRESHOLDS):
        out = F.when(threshold == value, F.lit(rank)).otherwise(out)
    return out


def billed_buckets() -> dict[str, Column]:
    """Tokens of one request by the rate they are billed at."""
    def tokens(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("bigint")

    split = tokens("cache_write_5m") + tokens("cache_write_1h") + tokens("cache_write_30m") + tokens("cache_write_12h")
    written = F.coalesce(F.col("cache_write_tokens"), split)
    zero = F.lit(0).cast("bigint")
    return {
        "fresh": F.greatest(tokens("input_tokens") - tokens("cached_input_tokens") - written, zero),
        "cached": tokens("cached_input_tokens"),
        "write_5m": tokens("cache_write_5m"),
        "write_1h": tokens("cache_write_1h"),
        "write_30m": tokens("cache_write_30m"),
        "write_12h": tokens("cache_write_12h"),
        "write": F.greatest(written - split, zero),
        "output": tokens("output_tokens"),
        "reasoning": tokens("reasoning_tokens"),
    }


def with_cost(df: DataFrame, cards: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Price rows that carry model, size_class and a struct ``billed``.

    The cost is linear in the billed buckets, so a row may be one request or
    the sums of many with the same model and size class.
    """
    costed = _with_cost_flags(df, cards, ids)
    return costed.select(
        *df.columns, "source_model", "inherited", "long_context", "cost_pico",
        F.when(F.col("_unsized"), UNSIZED).when(F.col("_unpriced"), _unpriced_text()).alias("price_warning"),
        F.when(F.col("_short"), _short_text()).when(F.col("_no_long"), _no_long_text()).alias("price_assumption"),
    )


UNSIZED = "unknown_request_context"


def _unpriced_text() -> Column:
    named = F.concat(F.lit("unknown_pricing_model:"), M.pricing_model_id(F.col("model")))
    return F.when(F.col("model").isNull(), "unknown_pricing").otherwise(named)


def _short_text() -> Column:
    return F.concat(F.lit("assumed_short_context_rates:"), F.col("_base"))


def _no_long_text() -> Column:
    return F.concat(F.lit("missing_long_context_pricing:"), F.col("_base"))


def _with_cost_flags(df: DataFrame, cards: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``with_cost`` with flags for its warning and assumption. Their texts follow from the flags, the model and ``_base``,
    the card of its request-size rule; so flags can be counted where texts would have to be gathered.
    """
    joined = with_rates(df, cards, ids)
    unknown = F.col("_r.tiered") & (F.col("size_class") < 0)
    above = F.col("_r.tiered") & (F.col("size_class") > _threshold_class(F.col("_r.threshold")))
    unpriced_size = unknown & (F.col("_r.unknown_size") == "unpriced")
    no_long = above & F.col("_r.long_rates").isNull()
    billed_at = (
        F.when(unpriced_size, None)
        .when(above & F.col("_r.long_rates").isNotNull(), F.col("_r.long_rates"))
        .when(no_long & (F.col("_r.missing_long") == "unpriced"), None)
        .otherwise(F.col("_r.base_rates"))
    )
    # Whole numbers of 64 bits hold nine products of these sizes; decimals hold all others.
    small = (F.greatest(*[F.col(f"billed.{b}") for b in BILLED]) < 1 << 30) & (F.greatest(*[F.col(f"_rates.{b}") for b in BILLED]) < 1 << 29)
    whole = reduce(lambda a, b: a + b, [F.col(f"billed.{b}").cast("bigint") * F.col(f"_rates.{b}").cast("bigint") for b in BILLED]).cast("decimal(38,0)")
    exact = reduce(lambda a, b: a + b, [F.col(f"billed.{b}").cast("decimal(20,0)") * F.col(f"_rates.{b}") for b in BILLED]).cast("decimal(38,0)")
    cost = F.when(small, whole).otherwise(exact)
    failed = F.col("cost_pico").isNull()
    sized_out = F.col("model").isNotNull() & F.coalesce(unpriced_size, F.lit(False))
    short = F.coalesce(unknown & (F.col("_r.unknown_size") == "short-context"), F.lit(False))
    flat = F.coalesce(no_long & (F.col("_r.missing_long") == "base"), F.lit(False))
    return (
        joined.withColumn("_rates", billed_at)
        .withColumn("cost_pico", cost)
        .select(
            *df.columns, "_r.source_model", "_r.inherited", F.coalesce(above & F.col("_r.long_rates").isNotNull(), F.lit(False)).alias("long_context"), "cost_pico",
            F.col("_r.base_model").alias("_base"), (failed & sized_out).alias("_unsized"), (failed & ~sized_out).alias("_unpriced"), short.alias("_short"), (~short & flat).alias("_no_long"),
        )
    )


def pico_to_micro(c: Column) -> Column:
    """Round to whole micro-USD, half up (costs are never negative)."""
    half_up = c + F.lit(500_000).cast("decimal(38,0)")
    whole = F.call_function("div", half_up, F.lit(1_000_000).cast("decimal(38,0)")).cast("bigint")
    return F.when(c < 10**18, F.call_function("div", c.cast("bigint") + 500_000, F.lit(1_000_000))).otherwise(whole)


def micro_to_usd(c: Column) -> Column:
    return c.cast("double") / F.lit(1_000_000.0)


def price_requests(requests: DataFrame, cards: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Each request with its unrounded cost, card, warning and assumption."""
    prepared = requests.withColumn("size_class", size_class(F.col("request_input_tokens"))).withColumn(
        "billed", F.struct(*[c.alias(b) for b, c in billed_buckets().items()])
    )
    priced = with_cost(prepared, cards, ids)
    return priced.drop("billed", "size_class")


# ---------------------------------------------------------------- session cost

def session_slices(requests: DataFrame, cards: DataFrame, key: list[str], session_models: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """One row per (session, model): tokens, request count and cost.

    Requests are summed by (session, model, size class) before anything else,
    so a session of any length reaches the shuffle as a few rows per task. Tokens
    billed as they are counted (SAME) are summed once. All sums are of fixed width,
    so that they are hash aggregates; warnings are counted as flags and written once a slice.
    A request without a model takes the session's model: ``session_models``
    (key, session_model) when given, else the first model of the session.
    """
    prepared = requests.select(
        *key, "model", "ord", size_class(F.col("request_input_tokens")).alias("size_class"), *BUCKETS,
        *[c.alias(f"b_{b}") for b, c in billed_buckets().items() if b not in SAME],
    )
    sums = prepared.groupBy(*key, "model", "size_class").agg(
        F.count("*").alias("request_count"),
        F.min("ord").alias("first_ord"),
        *[F.sum(F.coalesce(F.col(b), F.lit(0)).cast("bigint")).alias(b) for b in BUCKETS],
        *[F.sum(f"b_{b}").alias(f"b_{b}") for b in BILLED if b not in SAME],
    )
    if session_models is None:
        by_session = Window.partitionBy(*key)
        filled = sums.withColumn("_fallback", F.min_by("model", F.when(F.col("model").isNotNull(), F.col("first_ord"))).over(by_session))
    else:
        filled = sums.join(session_models.withColumnRenamed("session_model", "_fallback"), key, "left")
    filled = filled.withColumn("model", F.coalesce("model", "_fallback")).drop("_fallback")
    billed = F.struct(*[F.col(SAME.get(b, f"b_{b}")).alias(b) for b in BILLED])
    filled = filled.withColumn("billed", billed).drop(*[f"b_{b}" for b in BILLED if b not in SAME])
    priced = _with_cost_flags(filled, cards, ids)
    flags = ["_unsized", "_unpriced", "_short", "_no_long"]
    # One model has one _base.
    slices = priced.groupBy(*key, "model", "_base").agg(
        F.sum("request_count").alias("request_count"),
        F.min("first_ord").alias("first_ord"),
        *[F.sum(b).alias(b) for b in BUCKETS],
        F.when(F.count_if(F.col("cost_pico").isNull()) == 0, F.sum("cost_pico")).alias("cost_pico"),
        *[(F.count_if(f) > 0).alias(f) for f in flags],
    )
    return slices.select(
        *key, "model", "request_count", "first_ord", *BUCKETS, "cost_pico",
        F.array_compact(F.array(F.when(F.col("_unsized"), UNSIZED), F.when(F.col("_unpriced"), _unpriced_text()))).alias("price_warnings"),
        F.array_compact(F.array(F.when(F.col("_short"), _short_text()), F.when(F.col("_no_long"), _no_long_text()))).alias("price_assumptions"),
        pico_to_micro(F.col("cost_pico")).alias("cost_micro"),
    )


SLICE_FIELDS = [
    "model", "request_count", "input_tokens", "cached_input_tokens", "cache_write_tokens", "cache_write_30m",
    "cache_write_12h", "output_tokens", "reasoning_tokens", "total_tokens", "cost_micro",
]


def session_costs(slices: DataFrame, key: list[str]) -> DataFrame:
    """One row per session: token sums, cost, model slices, price warnings.

    The cost is NULL unless every request of the session is priced.
    """
    ordered = F.sort_array(F.collect_list(F.struct("first_ord", F.coalesce("model", F.lit("")).alias("m"), F.struct(*SLICE_FIELDS).alias("slice"))))

    def gathered(column: str) -> Column:
        """Sorted distinct texts; a slice without any puts nothing into the list."""
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.size(column) > 0, F.col(column))))))

    return slices.groupBy(*key).agg(
        F.sum("request_count").alias("request_count"),
        F.min_by("model", F.when(F.col("model").isNotNull(), F.col("first_ord"))).alias("first_model"),
        *[F.sum(b).alias(b) for b in BUCKETS],
        pico_to_micro(F.when(F.count_if(F.col("cost_pico").isNull()) == 0, F.sum("cost_pico"))).alias("cost_micro"),
        ordered["slice"].alias("model_usage"),
        gathered("price_warnings").alias("price_warnings"),
        gathered("price_assumptions").alias("price_assumptions"),
    )
