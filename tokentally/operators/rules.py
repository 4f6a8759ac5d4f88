"""Rule reports. Every rule reads one wide aggregate; each firing rule is a row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokentally.functions import text
from tokentally.operators import filters as X
from tokentally.operators import groups as G
from tokentally.operators.groups import has_warning, important_failures, ratio, total

c = F.col


@dataclass
class Signal:
    """A detector. Its metric is two whole numbers and how to show them."""

    id: str
    title: str
    tone: str
    fires: Column
    show: str = "none"  # count, percent, suffix, per_edit or none
    part: Column | None = None
    whole: Column | None = None
    word: str = ""
    affected: Column | None = None  # which sessions it points at
    critical: bool = False


def metric_text() -> Column:
    """Text of a metric row (show, part, whole, word), formatted once per row."""
    compact = text.compact_number(c("part"))
    plural = F.when(c("part") == 1, c("word")).otherwise(F.concat("word", F.lit("s")))
    tokens = F.when(c("part") == 1, " token / edit").otherwise(" tokens / edit")
    return (
        F.when(c("show") == "count", F.concat(compact, F.lit(" "), plural))
        .when(c("show") == "percent", text.percent_text(c("part"), c("whole")))
        .when(c("show") == "suffix", F.concat(compact, F.lit(" "), "word"))
        .when(c("show") == "per_edit", F.concat(compact, tokens))
        .otherwise("")
    )


def session_flags() -> dict[str, Column]:
    """Session predicates of the health rules. A NULL edit count is not a no-edit session here."""
    heavy = c("output_tokens").cast("double") / F.greatest("total_tokens", F.lit(1)).cast("double") > 0.35
    return {
        "command_issue": important_failures() > 0,
        "no_code": F.coalesce(c("file_edit_count") == 0, F.lit(False)),
        "unknown_surface": F.coalesce(c("detected_surface") == "unknown", F.lit(False)),
        "parse_failure": G.is_parse_failure(),
        "unknown_cost": c("cost_micro").isNull(),
        "any_session": F.lit(True),
        "output_heavy": heavy,
        "unverified": has_warning(G.UNVERIFIED),
    }


def health_facts(sessions: DataFrame, in_view: Column) -> DataFrame:
    """One row: what was scanned, and sums over the visible sessions in view.

    Sessions are summed once, by (repo, app), in numbers alone unless a caller reads ``top``; repos and apps
    are counted over those cells.
    """
    seen = G.is_visible()
    view = seen & in_view

    def add(column: str | Column) -> Column:
        return total(F.when(view, c(column) if isinstance(column, str) else column))

    dearest = F.struct(-c("cost_micro"), c("id"))
    flags = [F.count_if(view & test).alias(f"n_{name}") for name, test in session_flags().items()]
    cells = sessions.groupBy("repo_root", "source_app").agg(
        F.count_if(seen).alias("scan_sessions"), F.count_if(~seen).alias("scan_zero_tokens"),
        F.count_if(view).alias("sessions"),
        *[add(name).alias(name) for name in ("input_tokens", "cached_input_tokens", "output_tokens", "total_tokens", "shell_command_count",
                                             "important_command_failures", "failed_tool_call_count", "file_edit_count")],
        F.count_if(view & (F.coalesce("file_edit_count", F.lit(0)) == 0)).alias("no_code_change"),
        F.sum(F.when(view, c("cost_micro"))).alias("cost_micro"), F.max(F.when(view, c("cost_micro"))).alias("top_cost"),
        F.min_by(F.struct("id", "title", "cost_micro"), F.when(view & c("cost_micro").isNotNull(), dearest)).alias("top"),
        *flags,
    )
    kept = ("repo_root", "source_app", "top_cost", "top")
    top_of = F.when(c("top").isNotNull(), F.struct(-c("top.cost_micro"), c("top.id")))
    return cells.agg(
        F.countDistinct(F.when(c("scan_sessions") > 0, c("repo_root"))).alias("scan_repos"),
        F.countDistinct(F.when(c("scan_sessions") > 0, c("source_app"))).alias("scan_apps"),
        *[total(name).alias(name) for name in cells.columns if name not in kept],
        F.max("top_cost").alias("top_cost"), F.min_by("top", top_of).alias("top"),
    )


def health_signals_list() -> list[Signal]:
    """Detectors in display order, over the columns of health_facts."""
    sessions, edits, tokens = c("sessions"), c("file_edit_count"), c("total_tokens")
    cached, inputs = c("cached_input_tokens"), c("input_tokens")
    cached_share = ratio(cached, inputs)
    failures = F.when(c("important_command_failures") > 0, c("important_command_failures")).otherwise(c("failed_tool_call_count"))
    flags = session_flags()

    def some(flag: str, signal: str, title: str, word: str = "session", critical: bool = False) -> Signal:
        n = c(f"n_{flag}")
        return Signal(signal, title, "attention", n > 0, "count", n, word=word, affected=flags[flag], critical=critical)

    per_edit = F.round(tokens.cast("double") / F.nullif(edits, F.lit(0)).cast("double")).cast("bigint")
    top_cost = F.coalesce("top_cost", F.lit(0))
    return [
        Signal("repo-grouping", "Repo grouping is working", "good", c("scan_repos") > 0, "count", c("scan_sessions"), word="session"),
        Signal("app-attribution", "App attribution is visible", "good", c("scan_apps") > 1, "count", c("scan_apps"), word="app"),
        Signal("priced-sessions", "All loaded sessions are priced", "good", (c("n_unknown_cost") == 0) & (sessions > 0), "suffix", sessions, word="priced"),
        Signal("cache-reuse", "Cache reuse is strong", "good", cached_share >= 0.75, "percent", cached, inputs),
        Signal("token-roi-measurable", "Token ROI can be measured", "good", (edits > 0) & (tokens > 0), "per_edit", per_edit),
        Signal("empty-filter", "No sessions in this view", "attention", sessions == 0),
        Signal("command-friction", "Possible failed command rate looks high", "attention", ratio(failures, c("shell_command_count")) > 0.2,
               "percent", failures, c("shell_command_count"), affected=flags["command_issue"]),
        Signal("no-code-sessions", "Many sessions have no detected edits", "attention", (ratio(c("no_code_change"), sessions) > 0.5) & (sessions >= 3),
               "percent", c("no_code_change"), sessions, affected=flags["no_code"]),
        some("unknown_surface", "unknown-surfaces", "Some surfaces are unknown"),
        some("parse_failure", "parse-failures", "Some session files parsed partially", "issue", critical=True),
        some("unknown_cost", "unknown-cost", "Some sessions cannot be priced", critical=True),
        Signal("low-cache", "Cache rate could be better", "attention", (inputs > 0) & (cached_share < 0.5), "percent", cached, inputs, affected=flags["any_session"]),
        Signal("output-heavy", "Output-heavy sessions are driving tokens", "attention", ratio(c("output_tokens"), tokens) > 0.35,
               "percent", c("output_tokens"), tokens, affected=flags["output_heavy"]),
        Signal("cost-concentration", "Spend is concentrated in one session", "attention", ratio(top_cost, c("cost_micro")) > 0.35,
               "percent", top_cost, c("cost_micro")),
        some("unverified", "unverified-repos", "Some repos are unverified"),
        Signal("zero-token-skipped", "Zero-token placeholders were skipped", "attention", c("scan_zero_tokens") > 0, "suffix", c("scan_zero_tokens"), word="skipped"),
    ]


AFFECTED_COUNTS = {
    "command-friction": "n_command_issue", "no-code-sessions": "n_no_code", "unknown-surfaces": "n_unknown_surface",
    "parse-failures": "n_parse_failure", "unknown-cost": "n_unknown_cost", "low-cache": "n_any_session",
    "output-heavy": "n_output_heavy", "unverified-repos": "n_unverified",
}


def whole_number(value: Column | None) -> Column:
    return (F.lit(0) if value is None else F.coalesce(value, F.lit(0))).cast("bigint")


def health_signals(sessions: DataFrame, in_view: Column | None = None) -> DataFrame:
    """One row per firing detector, with the number of sessions it points at."""
    facts = health_facts(sessions, F.lit(True) if in_view is None else in_view)
    rows = []
    for place, signal in enumerate(health_signals_list()):
        affected = c(AFFECTED_COUNTS[signal.id]) if signal.id in AFFECTED_COUNTS else F.lit(1 if signal.id == "cost-concentration" else 0)
        rows.append(F.struct(
            F.lit(place).alias("place"), F.lit(signal.id).alias("id"), F.lit(signal.title).alias("title"), F.lit(signal.tone).alias("tone"),
            F.lit(signal.critical).alias("critical"), F.lit(signal.show).alias("show"), whole_number(signal.part).alias("part"),
            whole_number(signal.whole).alias("whole"), F.lit(signal.word).alias("word"),
            affected.cast("bigint").alias("affected_sessions"), F.coalesce(signal.fires, F.lit(False)).alias("fires"),
        ))
    fired = facts.select(F.inline(F.array(*rows))).where("fires")
    return fired.select("id", "title", "tone", "critical", metric_text().alias("metric"), "affected_sessions")


def health_affected(sessions: DataFrame, in_view: Column | None = None) -> DataFrame:
    """(signal, session id) rows of the firing detectors.

    Kept as rows: a detector may point at most of the sessions there are.
    """
    in_view = F.lit(True) if in_view is None else in_view
    signals = [s for s in health_signals_list() if s.affected is not None]
    fired = health_facts(sessions, in_view).select(F.struct(
        *[s.fires.alias(s.id) for s in health_signals_list()], c("top.id").alias("top_id")
    )).scalar()
    named = [F.when(c("_f").getField(s.id) & s.affected, F.lit(s.id)) for s in signals]
    named.append(F.when(c("_f").getField("cost-concentration") & (c("id") == c("_f.top_id")), F.lit("cost-concentration")))
    rows = sessions.where(G.is_visible() & in_view).withColumn("_f", fired)
    return rows.select(F.explode(F.array_compact(F.array(*named))).alias("signal"), "id")


def health_counts(sessions: DataFrame, in_view: Column | None = None) -> DataFrame:
    """One row: firing good, attention and critical detectors, and distinct sessions they point at."""
    signals = health_signals(sessions, in_view).agg(
        F.count_if(c("tone") == "good").alias("healthy_count"), F.count_if(c("tone") == "attention").alias("attention_count"),
        F.count_if("critical").alias("critical_count"),
    )
    affected = health_affected(sessions, in_view).agg(F.countDistinct("id")).scalar()
    return signals.withColumn("affected_session_count", affected)


# ---------------------------------------------------------------- waste

WASTE_TITLES = {
    "high-token-no-edit": "High-token no-edit sessions",
    "high-token-low-output": "High-token low-output sessions",
    "command-issue-sessions": "Possible failed command sessions",
    "unknown-repos": "Unknown repo sessions",
    "unknown-surfaces": "Unknown surface sessions",
    "repeated-errors": "Repeated error signals",
}


def waste_signals(sessions: DataFrame) -> DataFrame:
    counts = X.count_predicates(sessions, X.waste_predicates()).where("sessions > 0")
    title = F.lit("")
    for signal, name in WASTE_TITLES.items():
        title = F.when(c("id") == signal, name).otherwise(title)
    return counts.select("id", title.alias("title"), text.count_text(c("sessions"), "session").alias("value"), F.lit("attention").alias("tone"), "sessions")


def waste_affected(sessions: DataFrame) -> DataFrame:
    """(signal, session id) rows."""
    named = [F.when(test, F.lit(name)) for name, test in X.waste_predicates().items()]
    return sessions.select(F.explode(F.array_compact(F.array(*named))).alias("signal"), "id")


# ---------------------------------------------------------------- insights

def key_insights(sessions: DataFrame) -> DataFrame:
    """Up to six rows: top repos, no-edit sessions, top app, cache reuse, costliest session.

    Sessions are summed once, by (repo, app); repos and apps are summed from that.
    """
    cells = sessions.groupBy("repo_root", "source_app").agg(
        F.min("repo_name").alias("repo_name"), total("total_tokens").alias("tokens"), F.sum("cost_micro").alias("cost"), F.count("*").alias("n"),
        F.count_if(F.coalesce("file_edit_count", F.lit(0)) == 0).alias("no_edit"), total("input_tokens").alias("input"),
        total("cached_input_tokens").alias("cached"), F.max("cost_micro").alias("top_cost"),
    )
    sums = [F.sum(k).alias(k) for k in ("tokens", "cost", "n", "no_edit", "input", "cached")]
    repos = cells.groupBy("repo_root").agg(F.min("repo_name").alias("label"), *sums, F.max("top_cost").alias("top_cost"))
    apps = cells.groupBy(c("source_app").alias("label")).agg(F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    pair = F.struct("label", "tokens", "cost")
    facts = repos.agg(
        F.min_by(pair, F.struct(-c("tokens"), -F.coalesce("cost", F.lit(0)), c("repo_root"))).alias("by_tokens"),
        F.min_by(pair, F.when(c("cost").isNotNull(), F.struct(-c("cost"), -c("tokens"), c("repo_root")))).alias("by_cost"),
        *[F.sum(k).alias(k) for k in ("n", "no_edit", "input", "cached")], F.max("top_cost").alias("top_cost"),
    ).withColumn("app", apps.agg(F.min_by(pair, F.struct(-F.coalesce("cost", F.lit(0)), -c("tokens"), c("label")))).scalar())

    def row(place: int, label: str, when: Column, sentence: Column, metric: Column, tone: Column | str) -> Column:
        tone = F.lit(tone) if isinstance(tone, str) else tone
        return F.struct(F.lit(place).alias("place"), F.lit(label).alias("label"), sentence.alias("text"), metric.alias("metric"), tone.alias("tone"), when.alias("fires"))

    no_edit = text.count_text(c("no_edit"), "session")
    share = text.percent_text(c("cached"), c("input"))
    dear = text.money_text(c("top_cost"))
    rows = F.array(
        row(1, "Most-used repo", c("by_tokens.label").isNotNull(), F.concat("by_tokens.label", F.lit(" used the most tokens in this period.")),
            text.tokens_text(c("by_tokens.tokens")), "neutral"),
        row(2, "Highest API-equivalent cost", c("by_cost.label").isNotNull(),
            F.concat("by_cost.label", F.lit(" had the highest estimated API-equivalent cost.")), text.money_text(c("by_cost.cost")), "attention"),
        row(3, "No-edit sessions", c("n") > 0,
            F.when(c("no_edit") == 0, "No no-edit sessions were detected.").otherwise(F.concat(no_edit, F.lit(" used tokens without detected file edits."))),
            F.when(c("no_edit") == 0, "0").otherwise(no_edit), F.when(c("no_edit") == 0, "good").otherwise("attention")),
        row(4, "Most-used app", c("app.label").isNotNull(), F.concat("app.label", F.lit(" accounts for most detected local Codex usage.")),
            text.tokens_text(c("app.tokens")), "neutral"),
        row(5, "Cache reuse", c("input") > 0, F.concat(F.lit("Cached input represents "), share, F.lit(" of input tokens.")), share,
            F.when(ratio(c("cached"), c("input")) >= 0.5, "good").otherwise("attention")),
        row(6, "Session to inspect", c("top_cost").isNotNull(), F.concat(F.lit("The most expensive session was "), dear, F.lit(" API-equivalent.")), dear, "attention"),
    )
    return facts.select(F.inline(rows)).where("fires").drop("fires", "place")


# ---------------------------------------------------------------- confidence

def confidence_facts(sessions: DataFrame, sources: DataFrame) -> DataFrame:
    """One row of coverage counts.

    ``sources`` has available, warning_count, sessions_imported and
    parse_failure_count per source; ``sessions`` are all scanned ones.
    """
    seen = G.is_visible()
    tokens = seen & (c("total_tokens") > 0)
    unknown_repo = has_warning(G.UNVERIFIED)
    side = sources.agg(F.struct(
        F.count_if("available").alias("source_count"), total("sessions_imported").alias("imported"),
        total("parse_failure_count").alias("parse"), total("warning_count").alias("warnings"),
    )).scalar()
    counts = sessions.agg(
        F.count("*").alias("raw_sessions"), F.count_if(seen).alias("session_count"), F.count_if(tokens).alias("token_data_sessions"),
        F.count_if(seen & ((c("total_tokens") == 0) | has_warning("missing_token_breakdown"))).alias("missing_token_sessions"),
        F.count_if(tokens & c("cost_micro").isNotNull()).alias("priced_token_sessions"),
        F.count_if(tokens & c("cost_micro").isNull()).alias("unpriced_token_sessions"),
        F.count_if(tokens & (c("token_confidence") == "high")).alias("high_confidence_token_sessions"),
        F.count_if(seen & ~unknown_repo).alias("verified_repo_sessions"), F.count_if(seen & unknown_repo).alias("unknown_repo_sessions"),
        F.count_if(seen & (F.coalesce("detected_surface", F.lit("unknown")) == "unknown")).alias("unknown_surface_sessions"),
        F.count_if(seen & G.is_parse_failure()).alias("parse_failures"),
    )
    return counts.withColumn("_s", side).select(
        *[k for k in counts.columns if k != "parse_failures"], "parse_failures", c("_s.source_count").alias("source_count"), c("_s.imported").alias("imported_sessions"),
        F.greatest("parse_failures", "_s.parse").alias("parse_issue_count"), c("_s.warnings").alias("source_warning_count"),
    )


def _coverage(part: Column, whole: Column, empty: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(empty)


def data_confidence(sessions: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: coverage, weighted score and label."""
    facts = confidence_facts(sessions, sources)
    n, tokens = c("session_count"), c("token_data_sessions")
    none = F.when(n > 0, F.lit(0.0)).otherwise(F.lit(1.0))
    out = facts.select(
        "*",
        _coverage(tokens, n, F.lit(1.0)).alias("token_data_pct"),
        _coverage(c("priced_token_sessions"), tokens, none).alias("pricing_coverage_pct"),
        _coverage(c("high_confidence_token_sessions"), tokens, none).alias("high_confidence_token_pct"),
        _coverage(c("verified_repo_sessions"), n, F.lit(1.0)).alias("verified_repo_pct"),
    )
    issues = c("parse_issue_count")
    parse = F.when(issues == 0, F.lit(1.0)).otherwise(1.0 - issues.cast("double") / F.greatest("raw_sessions", "session_count", F.lit(1)).cast("double"))
    raw = F.floor(100.0 * (
        c("token_data_pct") * 0.3 + c("pricing_coverage_pct") * 0.25 + c("verified_repo_pct") * 0.18
        + c("high_confidence_token_pct") * 0.12 + F.greatest(parse, F.lit(0.0)) * 0.15
    ) + 0.5).cast("bigint")
    score = F.when(c("source_count") == 0, 0).when(c("imported_sessions") == 0, 50).otherwise(raw).cast("bigint")
    return out.withColumn("score", score).withColumn(
        "label", F.when(c("score") >= 80, "High").when(c("score") >= 55, "Medium").otherwise("Low")
    ).drop("raw_sessions", "parse_failures", "imported_sessions")


def confidence_issues(sessions: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per data problem, with the number of sessions it touches."""
    facts = confidence_facts(sessions, sources)
    n, tokens = c("session_count"), c("token_data_sessions")
    no_source, no_tokens = c("source_count") == 0, (tokens == 0) & (n > 0)

    def row(place: int, issue: str, title: str, tone: str, when: Column, affected: Column) -> Column:
        return F.struct(F.lit(place).alias("place"), F.lit(issue).alias("id"), F.lit(title).alias("title"), F.lit(tone).alias("tone"),
                        affected.cast("bigint").alias("affected_sessions"), when.alias("fires"))

    rows = F.array(
        row(0, "no-local-sources", "No local source data found", "critical", no_source, F.lit(0)),
        row(1, "no-sessions-imported", "No sessions imported", "attention", ~no_source & (n == 0) & (c("imported_sessions") == 0), F.lit(0)),
        row(2, "no-token-data", "No token-bearing sessions", "critical", no_tokens, n),
        row(3, "missing-token-data", "Some sessions are missing token data", "attention", ~no_tokens & (c("missing_token_sessions") > 0), c("missing_token_sessions")),
        row(4, "unpriced-token-sessions", "Some token-bearing sessions are unpriced", "attention", c("unpriced_token_sessions") > 0, c("unpriced_token_sessions")),
        row(5, "parse-issues", "Parser issues detected", "attention", c("parse_issue_count") > 0, c("parse_failures")),
        row(6, "unknown-repo-grouping", "Some repo grouping is unverified", "attention", c("unknown_repo_sessions") > 0, c("unknown_repo_sessions")),
        row(7, "unknown-surfaces", "Some app surfaces are unknown", "attention", c("unknown_surface_sessions") > 0, c("unknown_surface_sessions")),
        row(8, "source-warnings", "Source warnings were reported", "attention", c("source_warning_count") > 0, F.lit(0)),
    )
    return facts.select(F.inline(rows)).where("fires").drop("fires", "place")
