"""Warning codes: readable text, category and tone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNPRICED_MODEL = "unknown_pricing_model:"

# Code -> readable text.
TEXTS = {
    "unknown_request_context": "This session lacks per-request input lengths, so context-tier pricing cannot be determined. Adding model rates or rescanning the same records will not recover those lengths.",
    "expensive_session_concentration": "Cost concentration is very high. One session accounts for most of this repo or folder’s estimated cost.",
    "failed commands": "Possible failed commands were detected in this repo or folder.",
    "command issues": "Possible failed commands were detected in this repo or folder.",
    "repo_unverified_no_git_root": "Repo/folder grouping is unverified because no Git root was detected.",
    "copilot_missing_cwd": "GitHub Copilot did not include a local workspace path, so the session is grouped under Unknown repo/folder.",
    "claude_synthetic_zero_usage": "Claude only persisted a synthetic zero-usage marker for this session, so the real model and token counts are unavailable locally.",
    "claude_session_split_by_activity_day": "Claude activity crossed day or model boundaries, so it was split for more accurate daily totals.",
    "unknown_pricing": "Some sessions cannot be priced because token splits or pricing coverage are missing.",
    "unknown_cost": "Some sessions cannot be priced because token splits or pricing coverage are missing.",
    "missing_token_breakdown": "Some sessions are missing detailed token breakdowns.",
    "low_cache_rate": "Cache reuse is low, so input tokens may be driving more estimated cost.",
    "output_heavy_sessions": "Output tokens are unusually high compared with total token volume.",
    "high-token no-edit": "A high-token session had no detected file edits.",
    "duplicate_or_stale_token_snapshots_skipped": "Duplicate or stale token snapshots were skipped while counting tokens.",
    "token_direct_usage_ignored_after_cumulative_snapshot": "Direct token usage was ignored after a cumulative snapshot to avoid double counting.",
    "copilot_partial_token_breakdown": "GitHub Copilot exposed a partial token breakdown for this session.",
    "copilot_duplicate_session_merged": "Duplicate GitHub Copilot session fragments were merged.",
    "unknown_fast_mode_pricing": "This session's API-equivalent cost is unavailable because it includes fast-mode turns without a published rate.",
    "model_inferred_from_import_source": "Model name was inferred from local import metadata.",
}
INVALID_SNAPSHOTS = "Invalid token snapshots were skipped while counting tokens."

# Code with ':' and '_' as spaces -> title, category, tone. A
# trailing * marks a prefix. Other codes are data caveats of tone info.
DETAILS = {
    "unknown request context": ("Missing request lengths", "pricing", "warning"),
    "unknown pricing model *": ("Unpriced request model", "pricing", "warning"),
    "assumed short context rates *": ("Short-context rates assumed", "pricing", "info"),
    "missing long context pricing *": ("Long-context card missing", "pricing", "warning"),
    "expensive session concentration": ("Cost concentrated in one session", "review", "warning"),
    "failed commands": ("Possible failed commands", "review", "critical"),
    "command issues": ("Possible failed commands", "review", "critical"),
    "high-token no-edit": ("High-token session without edits", "review", "warning"),
    "low cache rate": ("Low cache reuse", "review", "warning"),
    "output heavy sessions": ("Output-heavy sessions", "review", "info"),
    "unknown pricing": ("Some sessions cannot be priced", "pricing", "warning"),
    "unknown cost": ("Some sessions cannot be priced", "pricing", "warning"),
    "missing token breakdown": ("Missing token breakdowns", "data", "warning"),
    "claude synthetic zero usage": ("Claude synthetic usage marker", "data", "warning"),
    "repo unverified no git root": ("Repo grouping unverified", "data", "info"),
    "copilot missing cwd": ("Copilot missing workspace", "data", "info"),
    "copilot partial token breakdown": ("Partial Copilot token split", "data", "warning"),
    "claude session split by activity day": ("Claude session split by activity day", "normalization", "info"),
    "duplicate or stale token snapshots skipped": ("Duplicate token snapshots skipped", "normalization", "info"),
    "token direct usage ignored after cumulative snapshot": ("Token snapshots de-duplicated", "normalization", "info"),
    "invalid token snapshots*": ("Invalid token snapshots skipped", "normalization", "warning"),
    "copilot duplicate session merged": ("Duplicate Copilot fragments merged", "normalization", "info"),
    "model inferred from import source": ("Model inferred from metadata", "normalization", "info"),
}
CATEGORY_ORDER = ["review", "pricing", "data", "normalization"]
TONE_ORDER = ["critical", "warning", "info"]


def readable(warning: Column) -> Column:
    code = F.lower(warning)
    known = F.create_map(*[F.lit(x) for pair in TEXTS.items() for x in pair])
    model = F.substr(warning, F.lit(len(UNPRICED_MODEL) + 1))
    return (
        F.when(code.startswith(UNPRICED_MODEL), F.concat(F.lit("A request used "), model, F.lit(", which needs a usable rate in Settings.")))
        .when(code.startswith("invalid_token_snapshots"), INVALID_SNAPSHOTS)
        .otherwise(F.coalesce(F.try_element_at(known, code), F.regexp_replace(warning, "_", " ")))
    )


def detail(warning: Column) -> Column:
    """STRUCT<title, category, tone> of a warning code."""
    words = F.regexp_replace(F.lower(warning), "[:_]+", " ")
    plain = F.regexp_replace(warning, "_", " ")
    title = F.concat(F.upper(F.substring(plain, 1, 1)), F.substr(plain, F.lit(2)))

    def entry(title: Column, category: str, tone: str) -> Column:
        return F.struct(title.alias("title"), F.lit(category).alias("category"), F.lit(tone).alias("tone"))

    out = entry(title, "data", "info")
    for code, (name, category, tone) in reversed(DETAILS.items()):
        hit = words.startswith(code[:-1]) if code.endswith("*") else words == code
        out = F.when(hit, entry(F.lit(name), category, tone)).otherwise(out)
    return out
