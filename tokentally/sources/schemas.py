"""Record schemas of the log formats: the union of every key spelling in use.

Records are parsed once, into these. Counts are text so that numbers and
numeric strings both read; VARIANT fields may be text or a list of parts. The
key names are fixed values: the log formats spell them so.
"""

from __future__ import annotations


def _fields(*names: str, kind: str = "STRING") -> str:
    return ", ".join(f"{n}: {kind}" for n in names)


TTL = "STRUCT<" + _fields("ttl_30m_tokens", "ttl30mTokens", "ttl_30m", "ttl_12h_tokens", "ttl12hTokens", "ttl_12h") + ">"
IN_DETAILS = "STRUCT<" + _fields(
    "cached_tokens", "cachedTokens", "cache_write_tokens", "cacheWriteTokens", "cache_creation_input_tokens", "cacheCreationInputTokens",
) + f", cache_write_tokens_details: {TTL}, cacheWriteTokensDetails: {TTL}>"
OUT_DETAILS = "STRUCT<" + _fields("reasoning_tokens", "reasoningTokens") + ">"
COUNTS = _fields(
    "input_tokens", "inputTokens", "prompt_tokens", "promptTokens", "cached_input_tokens", "cachedInputTokens",
    "cached_tokens", "cachedTokens", "cache_read_input_tokens", "output_tokens", "outputTokens", "completion_tokens",
    "completionTokens", "reasoning_tokens", "reasoningTokens", "reasoning_output_tokens", "reasoningOutputTokens", "total_tokens",
    "totalTokens", "tokens_used", "tokensUsed", "cache_creation_input_tokens", "cacheCreationInputTokens", "cache_write_input_tokens",
    "cacheWriteInputTokens", "cache_write_tokens", "cacheWriteTokens",
) + ", " + ", ".join(f"{n}: {IN_DETAILS}" for n in ("input_tokens_details", "inputTokensDetails", "prompt_tokens_details", "promptTokensDetails")) + ", " + ", ".join(
    f"{n}: {OUT_DETAILS}" for n in ("output_tokens_details", "outputTokensDetails")
) + f", cache_write_tokens_details: {TTL}, cacheWriteTokensDetails: {TTL}"
USAGE = f"STRUCT<{COUNTS}>"
MODE = "STRUCT<settings: STRUCT<model: STRING>>"
COMMON = (
    _fields(
    "type", "role", "timestamp", "created_at", "call_id", "callId",
    "name", "recipient_name", "output", "exit_code", "exitCode", "model",
    "id", "cwd", "title", "model_provider", "source", "originator",
    "thread_source", "command", "cmd", "argv", "args", "arguments",
    "action", "params",
)
    + ", " + _fields("text", "message", "content", "input", kind="VARIANT") + f", collaboration_mode: {MODE}, usage: {USAGE}, token_usage: {USAGE}, tokens: {USAGE}"
)
ROLLOUT_PAYLOAD = f"STRUCT<{COMMON}, info: STRUCT<last_token_usage: {USAGE}, total_token_usage: {USAGE}>>"
# A record may itself be the usage object, so the counts stand at the top as well.
ROLLOUT = f"STRUCT<{COMMON}, payload: {ROLLOUT_PAYLOAD}, response: STRUCT<usage: {USAGE}>, {COUNTS}, _corrupt: STRING>"

CACHE_SPLIT = "STRUCT<ephemeral_5m_input_tokens: STRING, ephemeral_1h_input_tokens: STRING>"
CLAUDE_USAGE = "STRUCT<" + _fields("input_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "output_tokens", "service_tier", "speed") + f", cache_creation: {CACHE_SPLIT}>"
TRANSCRIPT = (
    "STRUCT<" + _fields("type", "sessionId", "timestamp", "requestId", "cwd", "gitBranch", "entrypoint", "version", "aiTitle", "model")
    + f", payload: STRUCT<type: STRING, message: STRUCT<model: STRING>>, message: STRUCT<id: STRING, role: STRING, model: STRING, content: VARIANT, usage: {CLAUDE_USAGE}>"
    + ", toolUseResult: STRUCT<" + _fields("is_error", "error", "exit_code", "exitCode", "status_code", "statusCode", "status") + ">, _corrupt: STRING>"
)

OTEL = (
    "STRUCT<" + _fields(
    "type", "name", "body", "_body", "traceId", "spanId",
    "duration", "kind", "timestamp", "observedTimestamp", "timeUnixNano", "sid",
    "sessionId", "model", "ts",
)
    + ", startTime: VARIANT, endTime: VARIANT, hrTime: VARIANT, _hrTime: VARIANT, spanContext: STRUCT<traceId: STRING, spanId: STRING>, attributes: MAP<STRING, STRING>"
    + ", content: VARIANT, cwd: STRING, data: STRUCT<" + _fields("sessionId", "cwd", "role", "startTime", "newModel", "currentModel", "model", "title", "outputTokens")
    + ", content: VARIANT, context: STRUCT<cwd: STRING, gitRoot: STRING>, toolRequests: ARRAY<STRUCT<name: STRING, arguments: VARIANT>>>, _corrupt: STRING>"
)
_SELECTED = "STRUCT<id: STRING, identifier: STRING, metadata: STRUCT<version: STRING, family: STRING>>"
_CHAT = f"sessionId: STRING, inputState: STRUCT<selectedModel: {_SELECTED}>, selectedModel: {_SELECTED}, metadata: STRUCT<sessionId: STRING, resolvedModel: STRING>, response: STRUCT<metadata: STRUCT<resolvedModel: STRING>>"
CHAT = f"STRUCT<{_CHAT}, v: STRUCT<{_CHAT}>, data: STRUCT<{_CHAT}>, _corrupt: STRING>"
