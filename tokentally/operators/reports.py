"""Second-level tables over sessions, model rows and repo rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokentally.functions import labels as L
from tokentally.functions import models as M
from tokentally.functions import text
from tokentally.operators import filters as X
from tokentally.operators import groups as G
from tokentally.operators.groups import important_failures, ratio, total
from tokentally.operators.sorts import with_position
from tokentally.runtime import reliable_checkpoint


def source_stats(sessions: DataFrame) -> DataFrame:
    """One row per source client."""
    return sessions.groupBy(F.col("source_client").alias("source")).agg(
        F.countDistinct("source_path").alias("session_file_count"),
        F.count("*").alias("sessions_imported"),
        F.count_if(G.is_parse_failure()).alias("parse_failure_count"),
        F.count_if(F.col("parse_status") == "failed").alias("malformed_file_count"),
        text.iso_millis(F.max("ended_at")).alias("last_scanned_at"),
    )


def _spend() -> list[Column]:
    return [
        F.count("*").alias("session_count"), total("total_tokens").alias("total_tokens"), F.sum("cost_micro").alias("cost_micro"),
        F.count("cost_micro").alias("known_cost_sessions"), F.count_if(F.col("cost_micro").isNull()).alias("unknown_cost_sessions"),
        F.count_if(F.col("total_tokens") <= 0).alias("missing_token_sessions"),
    ]


def usage_by_source(sessions: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for every known source (id, label), used or not, and for any other one used."""
    used = sessions.groupBy(F.col("source_client").alias("id")).agg(*_spend())
    counts = ["session_count", "total_tokens", "known_cost_sessions", "unknown_cost_sessions", "missing_token_sessions"]
    return sources.join(used, "id", "full_outer").select(
        "id", F.coalesce("label", L.source_label(F.col("id"))).alias("label"), "cost_micro",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
    )


def usage_by_app(sessions: DataFrame) -> DataFrame:
    app = F.coalesce(F.nullif("source_app", F.lit("")), L.surface_label(F.col("detected_surface")))
    rows = sessions.groupBy(app.alias("id")).agg(*_spend()).withColumn("label", F.col("id"))
    return rows.orderBy(F.col("total_tokens").desc(), "label")


def token_stats(sessions: DataFrame) -> DataFrame:
    """One row: sessions per aggregation method and confidence, and the leaders."""
    method = F.coalesce("token_aggregation_method", F.lit("unknown"))
    confidence = F.coalesce("token_confidence", F.lit("low"))
    cells = sessions.groupBy(method.alias("method"), confidence.alias("confidence")).agg(
        F.count("*").alias("n"), total("token_snapshot_count").alias("snapshots"), F.count_if(F.col("total_tokens") > 0).alias("with_tokens")
    )

    def tally(column: str) -> Column:
        return F.transform(
            F.array_sort(F.collect_list(F.when(F.col("dimension") == column, F.struct(-F.col("n"), F.col("value"))))),
            lambda x: F.concat(x["value"], F.lit("="), (-x["col1"]).cast("string")),
        )

    # At most 5 methods x 3 confidences reach this point.
    sides = cells.select(
        F.inline(F.array(
            F.struct(F.lit("method").alias("dimension"), F.col("method").alias("value"), "n", "snapshots", "with_tokens"),
            F.struct(F.lit("confidence").alias("dimension"), F.col("confidence").alias("value"), "n", "snapshots", "with_tokens"),
        ))
    ).groupBy("dimension", "value").agg(*[F.sum(c).alias(c) for c in ("n", "snapshots", "with_tokens")])
    is_method = F.col("dimension") == "method"
    return sides.agg(
        tally("method").alias("_methods"), tally("confidence").alias("_confidences"),
        F.sum(F.when(is_method, F.col("snapshots"))).alias("token_snapshots"),
        F.sum(F.when(is_method, F.col("with_tokens"))).alias("sessions_with_token_data"),
        F.sum(F.when(is_method, F.col("n") - F.col("with_tokens"))).alias("sessions_missing_token_data"),
    ).select(
        L.method_label(F.split(F.get("_methods", F.lit(0)), "=")[0]).alias("method_label"),
        L.confidence_label(F.split(F.get("_confidences", F.lit(0)), "=")[0]).alias("confidence_label"),
        F.array_join("_methods", ";").alias("method_counts"), F.array_join("_confidences", ";").alias("confidence_counts"),
        "token_snapshots", "sessions_with_token_data", "sessions_missing_token_data",
    )


# ---------------------------------------------------------------- models

def model_usage(sessions: DataFrame) -> DataFrame:
    """Model rows with provider, cache rate, mean cost, top repo and latest session.

    Slices are summed by (model, repo) first; everything else is a sum or a
    best-of over those rows. No column names warnings, so none are gathered.
    """
    activity = F.coalesce("started_at", "ended_at")
    slices = G.model_slices(sessions).withColumn("_model", F.coalesce("model", F.lit("unknown-model"))).withColumn("_one", F.lit(1))
    per_repo = slices.groupBy(F.col("_model").alias("id"), "repo_root").agg(
        *G.usage_sums(), F.max_by(F.struct("id", activity.alias("at")), F.struct(activity, F.col("id"))).alias("latest"),
    )
    used = (F.col("total_tokens") > 0) | (F.coalesce("cost_micro", F.lit(0)) > 0)
    best = F.struct(-F.coalesce("cost_micro", F.lit(0)), -F.col("total_tokens"), F.col("repo_root"))
    sums = ["known_cost_sessions", "unknown_cost_sessions", *G.TOKENS, "session_count", "message_count"]
    rows = per_repo.groupBy("id").agg(
        F.sum("cost_micro").alias("cost_micro"), *[total(c).alias(c) for c in sums],
        F.min_by("repo_root", F.when(used, best)).alias("top_repo"),
        F.max_by("latest.id", F.struct("latest.at", "latest.id")).alias("latest_session"),
    )
    return rows.select(
        "id", F.when(F.col("id") == "unknown-model", "Model not recorded").otherwise(F.col("id")).alias("label"), "cost_micro", *sums,
        M.provider_label(F.col("id")).alias("provider_label"), ratio(F.col("cached_input_tokens"), F.col("input_tokens")).alias("cache_rate"),
        (F.col("cost_micro").cast("double") / 1_000_000.0 / F.col("session_count").cast("double")).alias("average_cost_usd"),
        "top_repo", "latest_session",
    )


def model_leaders(rows: DataFrame) -> DataFrame:
    """One row naming the model that leads each measure."""
    def leader(column: str) -> Column:
        return F.min_by("id", F.struct(-F.col(column), F.col("id"))).alias(f"top_{column}")

    unpriced = F.col("cost_micro").isNull() & (F.col("total_tokens") > 0)
    return rows.agg(
        *[leader(c) for c in ("cache_rate", "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_tokens")],
        F.count_if(unpriced).alias("models_with_unknown_cost"),
    )


def model_share(rows: DataFrame, metric: str, n: int) -> DataFrame:
    """The n largest models and their share of the positive total."""
    positive = reliable_checkpoint(rows.where(F.col(metric) > 0))
    whole = positive.agg(F.sum(metric)).scalar()
    return positive.orderBy(F.col(metric).desc(), "id").limit(n).select(
        "id", "label", F.col(metric).alias("value"), (F.col(metric).cast("double") / whole.cast("double")).alias("share")
    )


# ---------------------------------------------------------------- repos

def repo_model_breakdown(sessions: DataFrame) -> DataFrame:
    """(repo, model) sums with the model's share of the repo's known cost."""
    slices = G.model_slices(sessions)
    rows = slices.groupBy("repo_root", F.coalesce("model", F.lit("unknown-model")).alias("model")).agg(
        F.count("*").alias("session_count"), total("total_tokens").alias("total_tokens"), F.sum("cost_micro").alias("cost_micro")
    )
    repo_cost = sessions.groupBy("repo_root").agg(F.sum("cost_micro").alias("repo_cost"))
    share = F.when((F.col("repo_cost") > 0) & F.col("cost_micro").isNotNull(), F.col("cost_micro").cast("double") / F.col("repo_cost").cast("double"))
    return rows.join(repo_cost, "repo_root").select(*rows.columns, F.coalesce(share, F.lit(0.0)).alias("cost_share"))


def repo_daily(sessions: DataFrame) -> DataFrame:
    day = F.coalesce(F.date_format(F.coalesce("started_at", "ended_at"), "yyyy-MM-dd"), F.lit("Unknown"))
    return sessions.groupBy("repo_root", day.alias("day")).agg(total("cost_micro").alias("cost_micro"), total("total_tokens").alias("total_tokens"))


def _harmless() -> Column:
    return F.coalesce("harmless_non_zero_events", F.lit(0)) + F.coalesce("exploratory_misses", F.lit(0))


def repo_command_totals(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("repo_root").agg(
        total(important_failures()).alias("important"), total(_harmless()).alias("harmless"), total("repeated_failure_clusters").alias("repeated")
    )


def friction_by_repo(sessions: DataFrame) -> DataFrame:
    """Repos with any command signal."""
    clusters = F.coalesce("repeated_failure_clusters", F.lit(0))
    noisy = sessions.where((important_failures() != 0) | (_harmless() != 0) | (clusters != 0))
    rows = noisy.groupBy("repo_root").agg(
        F.min_by("repo_name", "id").alias("repo_name"), total(important_failures()).alias("important_failures"),
        total(_harmless()).alias("harmless_non_zero_events"), total(clusters).alias("repeated_failure_clusters"),
        F.count_if(X.needs_command_review()).alias("sessions_needing_review"), total("total_tokens").alias("total_tokens"),
        F.min_by("top_failure_type", F.when(F.col("top_failure_type").isNotNull(), F.col("id"))).alias("top_failure_type"),
        F.max(L.impact_rank(F.coalesce("command_issue_impact", F.lit("none")))).alias("_impact"), F.sum("cost_micro").alias("cost_micro"),
    )
    return rows.withColumn("impact", L.impact_of_rank(F.col("_impact"))).drop("_impact")


def friction_overview(sessions: DataFrame) -> DataFrame:
    """One row: sessions to review, harmless sessions, affected repos and the worst ones."""
    review = X.needs_command_review()
    worst = F.struct(-important_failures(), -F.coalesce("repeated_failure_clusters", F.lit(0)), -F.col("total_tokens"), F.col("id"))
    per_repo = sessions.groupBy("repo_root").agg(
        F.count_if(review).alias("review"), F.count_if(X.is_harmless()).alias("harmless"),
        F.bool_or((important_failures() != 0) | (_harmless() != 0) | (F.coalesce("repeated_failure_clusters", F.lit(0)) != 0)).alias("affected"),
        total(important_failures()).alias("important"), total("repeated_failure_clusters").alias("clusters"), total("total_tokens").alias("tokens"),
        F.sum(F.when(review, F.col("cost_micro"))).alias("review_cost"),
        F.min(F.when(review, worst)).alias("worst"),
    )
    flagged = F.col("affected") & ((F.col("important") > 0) | (F.col("clusters") > 0) | (F.col("review") > 0))
    rank = F.struct(-F.col("important"), -F.col("clusters"), -F.col("tokens"), F.col("repo_root"))
    top = per_repo.agg(
        F.sum("review").alias("review_sessions"), F.sum("harmless").alias("harmless_sessions"), F.count_if("affected").alias("affected_repos"),
        F.sum("review_cost").alias("cost_micro"),
        F.min_by(F.struct("repo_root", F.col("worst.id").alias("session")), F.when(flagged, rank)).alias("_top"),
        F.min("worst").alias("_worst"),
    )
    return top.select(
        "review_sessions", "harmless_sessions", "affected_repos", "cost_micro", F.col("_top.repo_root").alias("top_review_repo"),
        F.coalesce("_top.session", "_worst.id").alias("top_review_session"),
    )


def top_sessions(sessions: DataFrame, n: int) -> DataFrame:
    """The n costliest sessions when any is priced, else the n with most tokens."""
    priced = sessions.agg((F.count("cost_micro") > 0).alias("p")).scalar()
    key = F.when(priced, F.coalesce("cost_micro", F.lit(-1))).otherwise(F.col("total_tokens"))
    return sessions.orderBy(key.desc(), "id").limit(n)


def repo_cost_concentration(sessions: DataFrame) -> DataFrame:
    """Share of the costliest session, and of the three costliest, per repo.

    Only three rows per repo and task reach the shuffle of the ranking.
    """
    order = Window.partitionBy("repo_root").orderBy(F.col("cost_micro").desc(), "id")
    top = sessions.where("cost_micro is not null").select("repo_root", "id", "cost_micro", F.row_number().over(order).alias("rank")).where("rank <= 3")
    picked = top.groupBy("repo_root").agg(
        F.max("cost_micro").alias("top_cost"), F.sum("cost_micro").alias("three_cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]), ";").alias("top_sessions"),
    )
    totals = sessions.groupBy("repo_root").agg(F.coalesce(F.sum("cost_micro"), F.lit(0)).alias("total"))
    return totals.join(picked, "repo_root", "left").select(
        "repo_root", F.col("top_cost"), ratio(F.coalesce("top_cost", F.lit(0)), F.col("total")).alias("top_share"),
        F.col("three_cost"), ratio(F.coalesce("three_cost", F.lit(0)), F.col("total")).alias("three_share"),
        F.coalesce("top_sessions", F.lit("")).alias("top_sessions"),
        (ratio(F.coalesce("top_cost", F.lit(0)), F.col("total")) >= 0.5).alias("extreme"),
    )


def repo_warnings(sessions: DataFrame) -> DataFrame:
    """Warnings of each repo, with those of its spending pattern."""
    rows = G.with_codes(sessions, ["repo_root"]).groupBy("repo_root").agg(
        F.sum("cost_micro").alias("cost"), F.max("cost_micro").alias("max_cost"), *[total(c).alias(c) for c in ("input_tokens", "cached_input_tokens", "output_tokens", "total_tokens")],
        (F.count("_one") > F.count("cost_micro")).alias("unpriced"), G.code_set().alias("warnings"),
    )
    added = F.array_compact(F.array(
        F.when((F.col("cost") > 0) & (ratio(F.col("max_cost"), F.col("cost")) > 0.5), "expensive_session_concentration"),
        F.when((F.col("input_tokens") > 0) & (ratio(F.col("cached_input_tokens"), F.col("input_tokens")) < 0.1), "low_cache_rate"),
        F.when((F.col("total_tokens") > 0) & (ratio(F.col("output_tokens"), F.col("total_tokens")) > 0.5), "output_heavy_sessions"),
        F.when(F.col("unpriced"), "unknown_pricing"),
    ))
    return rows.select("repo_root", F.array_sort(F.array_union("warnings", added)).alias("warnings"))


def repo_metadata(sessions: DataFrame) -> DataFrame:
    edits = F.coalesce("file_edit_count", F.lit(0))
    return sessions.groupBy("repo_root").agg(
        F.countDistinct(F.nullif("source_path", F.lit(""))).alias("source_paths"), total(edits).alias("edits"),
        total("file_read_count").alias("reads"), F.count_if(edits > 0).alias("sessions_with_edits"),
    )


def repo_rank(sessions: DataFrame) -> DataFrame:
    """Cost rank of every repo (unpriced last, ties by root), its share, and the leader."""
    repos = sessions.groupBy("repo_root").agg(F.min_by("repo_name", "id").alias("repo_name"), F.sum("cost_micro").alias("cost_micro"))
    ranked = with_position(repos.orderBy(F.col("cost_micro").desc_nulls_last(), "repo_root"))
    overall = ranked.agg(F.struct(F.sum("cost_micro").alias("total"), F.count("*").alias("n"), F.min_by("repo_name", "position").alias("leader"))).scalar()
    return ranked.withColumn("_all", overall).select(
        "repo_root", (F.col("position") + 1).alias("cost_rank"), F.col("_all.n").alias("repos"),
        F.coalesce(ratio(F.col("cost_micro"), F.col("_all.total")), F.lit(0.0)).alias("share"), F.col("_all.leader").alias("leader"),
    )


REVIEW_REASONS = ["Highest estimated cost", "Longest duration", "Partial or failed outcome", "Possible failed commands", "Unusual token volume"]


def sessions_to_review(sessions: DataFrame) -> DataFrame:
    """At most six sessions per repo worth a look, with the reasons joined.

    Five best-of aggregates per repo name the sessions; ids break ties.
    """
    def best(value: Column, when: Column | None = None) -> Column:
        key = F.struct(-value, F.col("id"))
        return F.min_by("_s", key if when is None else F.when(when, key))

    kept = F.struct("id", "cost_micro", "total_tokens", "duration_ms", X.needs_command_review().alias("review"))
    unfinished = F.col("session_outcome").isin("partial", "failed")
    repos = sessions.withColumn("_s", kept).groupBy("repo_root").agg(
        F.count("*").alias("n"), F.sum("total_tokens").alias("tokens"),
        F.coalesce(best(F.col("cost_micro"), F.col("cost_micro").isNotNull()), best(F.col("total_tokens"))).alias("p0"),
        best(F.coalesce("duration_ms", F.lit(0))).alias("p1"),
        F.min_by("_s", F.when(unfinished, F.col("id"))).alias("p2"),
        best(important_failures()).alias("p3"),
        best(F.col("total_tokens")).alias("p4"),
    )
    mean = F.col("tokens").cast("double") / F.col("n").cast("double")
    outlier = (F.col("p4.total_tokens") >= G.HIGH_TOKENS) | ((mean > 0) & (F.col("p4.total_tokens") >= mean * 2.5))
    picks = F.array(*[
        F.struct(F.lit(i).alias("place"), F.lit(reason).alias("reason"), (F.when(outlier, F.col("p4")) if i == 4 else F.col(f"p{i}")).alias("s"))
        for i, reason in enumerate(REVIEW_REASONS)
    ])
    rows = repos.select("repo_root", "n", F.inline(picks)).where("s.id is not null").groupBy("repo_root", "n", "s").agg(
        F.array_sort(F.collect_list(F.struct("place", "reason"))).alias("_r")
    )
    reasons = F.transform("_r", lambda x, i: F.when(i == 0, x["reason"]).otherwise(F.lower(x["reason"])))
    shown = rows.select(
        "repo_root", F.col("s.id").alias("id"), "n", F.array_join(reasons, "; ").alias("reason"), F.get("_r", F.lit(0))["place"].alias("_place"),
        F.col("s.cost_micro").alias("cost_micro"),
        ((F.col("s.total_tokens") > 0) | F.col("s.cost_micro").isNotNull() | F.col("s.duration_ms").isNotNull() | F.col("s.review")).alias("_show"),
    ).where("_show")
    priority = (
        F.when(F.col("reason").contains("Highest"), 0).when(F.col("reason").contains("Command"), 1)
        .when(F.col("reason").contains("Partial"), 2).when(F.col("reason").contains("Unusual"), 3).otherwise(4)
    )
    order = Window.partitionBy("repo_root").orderBy(priority, F.coalesce("cost_micro", F.lit(-1)).desc(), "_place")
    return shown.withColumn("rank", F.row_number().over(order)).where("rank <= least(6, n)").select("repo_root", "id", "reason", "rank")


def latest_sessions(sessions: DataFrame, group: str) -> DataFrame:
    """The latest session of each group, by start, else end."""
    at = F.coalesce("started_at", "ended_at")
    return sessions.groupBy(group).agg(F.max_by("id", F.struct(at, F.col("id"))).alias("latest_session"))


# ---------------------------------------------------------------- pricing gaps

def unpriced_models() -> Column:
    """Model ids named by unknown_pricing_model warnings."""
    prefix = "unknown_pricing_model:"
    named = F.filter("warnings", lambda w: w.startswith(prefix) & (F.length(w) > len(prefix)))
    return F.transform(named, lambda w: F.substr(w, F.lit(len(prefix) + 1)))


TOKEN_DETAIL_WARNINGS = [
    "unknown_request_context", "missing_token_breakdown", "unknown_cost",
    "cursor_cost_not_estimated_from_prompt_tokens", "copilot_partial_token_breakdown",
]


def with_gap_reason(sessions: DataFrame, resolved: DataFrame) -> DataFrame:
    """Why a session has no price. ``resolved`` says which models have one."""
    known = resolved.select(F.col("model").alias("_model"), F.col("priced").alias("_priced"))
    buckets = ["input_tokens", "cached_input_tokens", "cache_write_tokens", "output_tokens", "reasoning_tokens"]
    any_tokens = F.lit(False)
    for bucket in buckets:
        any_tokens = any_tokens | (F.coalesce(bucket, F.lit(0)) > 0)
    flagged = F.arrays_overlap("warnings", F.array(*[F.lit(w) for w in TOKEN_DETAIL_WARNINGS]))
    model = F.trim("model")
    reason = (
        F.when(flagged | ~any_tokens, "missingTokenDetail")
        .when(model.isNull() | (model == "") | (model == "unknown-model"), "missingModel")
        .when(F.size(unpriced_models()) > 0, "missingPrice")
        .when(F.coalesce("_priced", F.lit(False)), "other")
        .otherwise("missingPrice")
    )
    joined = sessions.join(known, F.trim("model") == F.col("_model"), "left")
    return joined.withColumn("gap_reason", reason).drop("_model", "_priced")


def pricing_gap_summary(sessions: DataFrame, resolved: DataFrame) -> DataFrame:
    gaps = with_gap_reason(sessions.where(X.is_unpriced()), resolved)
    named = F.when(F.size(unpriced_models()) > 0, unpriced_models()).otherwise(F.array_compact(F.array("model")))
    missing = F.when(F.col("gap_reason") == "missingPrice", named)

    def of(reason: str) -> Column:
        return F.count_if(F.col("gap_reason") == reason)

    return G.with_codes(gaps, [], missing).agg(
        F.count("_one").alias("total"), of("missingPrice").alias("missing_price"), of("missingTokenDetail").alias("missing_token_detail"),
        of("missingModel").alias("missing_model"), of("other").alias("other"), G.code_set().alias("missing_price_models"),
    )


def used_pricing_models(used: DataFrame, cards: DataFrame, rules: DataFrame, resolved: DataFrame) -> DataFrame:
    """Card rows a settings page lists: used ids first, with the long cards they may
    bill at, then every other card.

    ``used`` has a column model; ``resolved`` comes from resolve_models over it.
    """
    ids = used.select("model").where("model is not null and model <> 'unknown-model'").distinct()
    long = (
        resolved.join(rules, F.col("source_model") == F.col("base_model")).select(F.col("long_model").alias("model"))
        .join(cards.select("model"), "model", "left_semi")
    )
    in_use = ids.unionByName(long).distinct().withColumn("used", F.lit(True))
    names = in_use.select("model").union(cards.select("model")).distinct()
    usable = cards.select("model", ((F.col("input") > 0) & (F.col("output") > 0)).alias("own_price"))
    return names.join(in_use, "model", "left").join(usable, "model", "left").select(
        "model", F.coalesce("used", F.lit(False)).alias("used"), F.coalesce("own_price", F.lit(False)).alias("own_price")
    )


# ---------------------------------------------------------------- pickers

def filter_options(groups: DataFrame, value: str, selected: list[str]) -> DataFrame:
    """Values of a facet with their tokens; selected values stay listed at 0."""
    found = groups.select(F.col(value).alias("value"), "label", F.col("total_tokens").alias("usage"))
    if not selected:
        return found
    found = reliable_checkpoint(found)  # once for the list and once for what it lacks
    wanted = groups.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in selected])).alias("value"))
    absent = wanted.join(found, "value", "left_anti").select("value", F.col("value").alias("label"), F.lit(0).cast("bigint").alias("usage"))
    return found.unionByName(absent)


def source_readiness(stats: DataFrame) -> DataFrame:
    """Sessions imported, whether data was found, and the next step, per source."""
    steps = {
        "cursor": "Open Cursor chat or agent sessions locally, then rescan.",
        "copilot": "Enable Copilot OTEL export or use Copilot Chat in VS Code, then rescan.",
        "claude": "Run Claude Code in a repo with local history enabled, then rescan.",
    }
    none = F.lit("Run Codex in a repo so local session files can be imported.")
    for source, step in steps.items():
        none = F.when(F.col("source") == source, step).otherwise(none)
    found = F.col("session_file_count") > 0
    step = (
        F.when(~found, "Install or run the local source once, then refresh.")
        .when(F.col("sessions_imported") == 0, none)
        .when(F.col("parse_failure_count") > 0, "Some files were skipped; check Settings for parse warnings.")
        .otherwise("Ready.")
    )
    return stats.select("source", "sessions_imported", found.alias("primary_data_found"), step.alias("next_step"))


# ---------------------------------------------------------------- avoided cost

def avoided_cost_rate(cards: DataFrame) -> Column:
    """Input rate of the default card: gpt-5.5, else gpt-5, else the first card, else 5."""
    order = F.when(F.col("model") == "gpt-5.5", 0).when(F.col("model") == "gpt-5", 1).otherwise(2)
    return F.coalesce(cards.agg(F.min_by(F.col("input"), F.struct(order, "position"))).scalar(), F.lit(5).cast("decimal(12,6)"))


def avoided_cost(tokens: Column, rate: Column) -> Column:
    """USD the tokens would have cost, to whole micro-USD."""
    return F.round(tokens.cast("double") * rate.cast("double")) / 1_000_000.0
