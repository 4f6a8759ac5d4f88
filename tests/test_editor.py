"""Files of the editor assistant, read from folders laid out as it writes them."""

import json

from tokentally import rates
from tokentally.operators import events
from tokentally.sources import editor, sessions


def write(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))


def span(trace, model, tokens, session=None):
    attributes = {"gen_ai.operation.name": "chat", "gen_ai.response.model": model, "gen_ai.usage.input_tokens": tokens, "gen_ai.usage.output_tokens": 2}
    if session:
        attributes["gen_ai.conversation.id"] = session
    return {"type": "span", "traceId": trace, "spanId": "s", "name": f"chat {model}", "startTime": [1700000000, 0], "endTime": [1700000001, 0], "attributes": attributes}


def test_folders_kinds_and_merge(spark, tmp_path):
    stored, home = tmp_path / "User/workspaceStorage/ws a", tmp_path / "home"
    write(stored / "workspace.json", [{"folder": "file:///tmp/my%20work"}])
    write(stored / "GitHub.copilot-chat/transcripts/a.jsonl", [
        {"type": "session.start", "data": {"sessionId": "sa", "startTime": "2026-05-24T17:55:47.405Z", "title": "Review"}, "timestamp": "2026-05-24T17:55:47.405Z"},
        {"type": "user.message", "data": {"content": "review  my changes"}, "timestamp": "2026-05-24T17:55:47.405Z"},
        {"type": "assistant.message", "data": {"content": "Now.", "toolRequests": [{"name": "run_in_terminal", "arguments": '{"command":"git status"}'}, {"name": "x", "arguments": {"command": "y"}}]}, "timestamp": "2026-05-24T17:55:53.608Z"},
    ])
    # Output tokens alone give way to detailed telemetry of the same session in another file.
    write(home / "session-state/one/workspace.yaml", ["cwd: /tmp/cli"])
    write(home / "session-state/one/events.jsonl", [
        {"type": "session.start", "data": {"sessionId": "sb", "context": {"cwd": "/tmp/other"}}, "timestamp": "2026-05-24T17:52:43.304Z"},
        {"type": "session.model_change", "data": {"newModel": "gpt-5-mini"}}, {"type": "session.model_change", "data": {"newModel": "auto"}},
        {"type": "assistant.message", "data": {"outputTokens": 520, "content": "Done."}}, "{cut",
    ])
    write(home / "session-state/two/events.jsonl", [{"type": "session.start", "data": {"sessionId": "sc"}}, {"type": "assistant.message", "data": {"outputTokens": 7}, "timestamp": "2026-05-24T17:52:53.137Z"}])
    write(home / "otel/t.jsonl", [span("t1", "gpt-5-mini", 10, "sb"), span("t2", "gpt-5", 10)])
    write(home / "otel/empty.jsonl", [{"type": "other"}])
    write(tmp_path / "elsewhere/notes.jsonl", [span("t3", "gpt-5", 10)])
    records = editor.read_editor_records(spark, str(tmp_path))
    rows = {r.id: r for r in sessions.editor_sessions(records, rates.bundled_cards_df(spark)).collect()}
    assert sorted(rows) == ["empty", "sa", "sb", "sc", "t2"]
    a, b, c = rows["sa"], rows["sb"], rows["sc"]
    assert (a.cwd, a.title, a.source_app, a.user_prompt_count, a.assistant_message_count, a.tool_call_count, a.shell_command_count, a.duration_ms) == ("/tmp/my work", "Review", "VS Code", 1, 1, 2, 1, 6203)
    assert a.total_tokens == 0 and a.cost_micro is None and "missing_token_breakdown" in a.warnings
    assert (b.cwd, b.model, b.input_tokens, b.output_tokens, b.parse_status, b.parse_error_count) == ("/tmp/cli", "gpt-5-mini", 10, 2, "partial", 1)
    assert b.cost_micro == 7 and "copilot_duplicate_session_merged" in b.warnings
    assert (c.output_tokens, c.total_tokens, c.cost_micro) == (7, 7, None) and "copilot_partial_token_breakdown" in c.warnings
    assert rows["t2"].repo_root == "unknown-copilot-repo" and rows["empty"].message_count == 0
    said = events.prompt_rows(events.activity_rows(events.event_rows(records))).where("file like '%a.jsonl'").orderBy("ord").collect()
    assert [(r.role, r.text) for r in said] == [("user", "review my changes"), ("assistant", "Now.")]
