"""Readable labels of codes, badges, and sentences about one session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokentally.functions import text

# Code -> label.
SOURCES = {
    "codex": "Codex", "claude": "Claude Code", "copilot": "GitHub Copilot", "gemini-cli": "Gemini CLI",
    "opencode": "OpenCode", "cursor": "Cursor",
}
SURFACES = {
    "terminal_cli": "Terminal", "vscode_extension": "VS Code", "local_agent": "Desktop local agent",
    "codex_exec": "Codex", "codex_app_cloud": "Codex app",
}
OUTCOMES = {
    "completed": "Completed", "partial": "Partial", "failed": "Failed", "research_only": "Research only",
    "no_code_change": "No edits", "setup_debugging": "Setup/debugging",
}
METHODS = {"final_snapshot": "Final checkpoint", "delta_sum": "Delta sum", "direct_usage": "Direct usage", "estimated": "Estimated"}
CONFIDENCES = {"high": "High", "medium": "Medium"}
IMPACTS = {"high": "High", "medium": "Medium", "low": "Low"}
IMPACT_RANKS = ["none", "low", "medium", "high"]
SEVERITY_RANKS = ["none", "ignored", "info", "warning", "critical"]


def coded(value: Column, labels: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for code, label in reversed(labels.items()):
        out = F.when(value == code, label).otherwise(out)
    return out


def source_label(value: Column) -> Column:
    return coded(value, SOURCES, "Unknown")


def surface_label(value: Column) -> Column:
    return coded(value, SURFACES, "Unknown")


def outcome_label(value: Column) -> Column:
    return coded(value, OUTCOMES, "Unknown")


def method_label(value: Column) -> Column:
    return coded(value, METHODS, "Unknown")


def confidence_label(value: Column) -> Column:
    return coded(value, CONFIDENCES, "Low")


def impact_label(value: Column) -> Column:
    return coded(value, IMPACTS, "None")


def failure_type_label(value: Column) -> Column:
    return F.coalesce(F.initcap(F.regexp_replace(F.nullif(value, F.lit("")), "_", " ")), F.lit("None"))


def rank_of(value: Column, ranks: list[str]) -> Column:
    out = F.lit(0)
    for rank, code in enumerate(ranks):
        out = F.when(value == code, rank).otherwise(out)
    return out


def impact_rank(value: Column) -> Column:
    return rank_of(value, IMPACT_RANKS)


def impact_of_rank(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in IMPACT_RANKS]), rank)


def severity_of_rank(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in SEVERITY_RANKS]), rank)


def scoped_app(app: Column, source: Column, surface: Column) -> Column:
    """App label that also names the tool: 'Codex on VS Code'."""
    named = F.coalesce(F.nullif(app, F.lit("")), surface_label(surface))
    tool = source_label(source)
    return (
        F.when(named == "Unknown", tool)
        .when((source == "copilot") & (named == "Copilot CLI"), "GitHub Copilot CLI")
        .when(F.lower(named).rlike("vs code|vscode|terminal|cli"), F.concat(tool, F.lit(" on "), named))
        .otherwise(named)
    )


def display_title(title: Column, first_prompt: Column, session_id: Column) -> Column:
    own = F.nullif(text.clean_title(F.coalesce(title, F.lit(""))), F.lit(""))
    prompt = F.nullif(text.clean_title(F.coalesce(first_prompt, F.lit(""))), F.lit(""))
    return F.coalesce(own, text.truncate_text(prompt, 120), F.concat(F.lit("Session "), F.substring(session_id, 1, 8)))


def service_tier_label(value: Column) -> Column:
    return F.coalesce(F.nullif(F.initcap(F.regexp_replace(F.lower(F.trim(value)), r"[-_\s]+", " ")), F.lit("")), F.lit("Unknown"))


def cache_reuse_label(cached: Column, total: Column) -> Column:
    rate = F.when(total > 0, cached.cast("double") / total.cast("double")).otherwise(F.lit(0.0))
    return F.when(rate >= 0.5, "strong").when(rate >= 0.2, "moderate").when(total > 0, "low").otherwise("unknown")


def dominant_bucket(*columns: tuple[str, Column]) -> Column:
    """Label of the largest value; the first listed wins a tie."""
    items = F.array(*[F.struct((-c).alias("v"), F.lit(i).alias("i"), F.lit(label).alias("label")) for i, (label, c) in enumerate(columns)])
    return F.array_min(items)["label"]


def token_intensity(tokens: Column, edits: Column) -> Column:
    each = tokens.cast("double") / F.nullif(edits, F.lit(0)).cast("double")
    return (
        F.when(F.coalesce(edits, F.lit(0)) <= 0, "No file edits detected")
        .when(each >= 1_000_000, "High token use per file edit")
        .when(each <= 100_000, "Low token use per file edit")
        .otherwise("Moderate token use per file edit")
    )


# ---------------------------------------------------------------- one session

def _important() -> Column:
    return F.coalesce("important_command_failures", "failed_tool_call_count", F.lit(0))


def _edits() -> Column:
    return F.coalesce("file_edit_count", F.lit(0))


def session_badges() -> Column:
    """Short labels of a session row, in display order."""
    outcome = outcome_label(F.col("session_outcome"))
    named = F.array_compact(F.array(
        F.when(_important() > 0, "Possible failed command"),
        F.when(F.col("total_tokens") >= 1_000_000, "High token"),
        F.when((_edits() == 0) & (outcome != "No edits"), "No edits"),
        F.when(F.array_contains("warnings", "repo_unverified_no_git_root"), "Unknown repo/folder"),
        F.when(F.coalesce("detected_surface", F.lit("unknown")) == "unknown", "Unknown surface"),
        F.when(_edits() > 0, "Files edited"),
        F.nullif(outcome, F.lit("Unknown")),
        F.when(F.col("cost_micro").isNull() & (F.col("total_tokens") > 0), "Unknown pricing"),
        F.when(F.array_contains("warnings", "claude_synthetic_zero_usage"), "Synthetic usage marker"),
        F.when(F.array_contains("warnings", "missing_token_breakdown"), "Unknown tokens"),
    ))
    return F.array_distinct(named)


def positive_signals() -> Column:
    share = F.when(F.col("input_tokens") > 0, F.col("cached_input_tokens").cast("double") / F.col("input_tokens").cast("double"))
    return F.array_compact(F.array(
        F.when(_edits() > 0, F.concat(text.count_text(_edits(), "file edit"), F.lit(" detected."))),
        F.when(_important() == 0, "No possible failed commands detected."),
        F.when(F.col("parse_status") == "ok", "Local session log parsed cleanly."),
        F.when(F.col("token_confidence") == "high", "Token counting confidence is high."),
        F.when(share >= 0.5, "Cached input reuse was strong."),
        F.when((F.col("repo_root") != "") & ~F.col("repo_root").contains("unverified"), "Session resolved to a repo or folder."),
    ))


def concern_signals() -> Column:
    outcome = F.col("session_outcome")
    unverified = F.lower("repo_name").contains("unknown") | F.array_contains("warnings", "repo_unverified_no_git_root")
    return F.array_compact(F.array(
        F.when(_important() > 0, F.concat(text.count_text(_important(), "possible failed command"), F.lit(" to review."))),
        F.when(outcome.isin("partial", "failed"), F.concat(F.lit("Outcome is "), F.lower(outcome_label(outcome)), F.lit("; check whether the work completed."))),
        F.when((_edits() == 0) & (F.col("total_tokens") > 1_000_000), "High-token session with no detected file edits."),
        F.when(F.col("cost_micro").isNull() & (F.col("total_tokens") > 0), "API-equivalent cost unavailable because pricing or token split is missing."),
        F.when(F.col("parse_status") != "ok", "Parser reported issues for this session."),
        F.when(F.col("detected_surface") == "unknown", "Surface could not be detected from local logs."),
        F.when(unverified, "Repo/folder grouping is unverified because no Git root was detected."),
        F.when((F.coalesce("token_snapshot_count", F.lit(0)) == 0) & (F.col("total_tokens") == 0), "No token checkpoints were available."),
    ))


UNPRICED_PHRASE = "unpriced cannot be priced missing pricing missing price missing token split missing token breakdown api-equivalent cost unavailable"


def search_text() -> Column:
    """Everything a session search looks at, in lower case."""
    from tokentally.functions.warnings import readable

    unpriced = F.when(F.col("cost_micro").isNull() & (F.col("total_tokens") > 0), UNPRICED_PHRASE)
    return F.lower(F.concat_ws(
        " ", "title", "id", "repo_name", "source_app", surface_label(F.col("detected_surface")), "model",
        outcome_label(F.col("session_outcome")), unpriced, F.transform("warnings", readable),
    ))


def matches_search(phrase: str) -> Column:
    wanted = phrase.strip().lower()
    return search_text().contains(wanted) if wanted else F.lit(True)
