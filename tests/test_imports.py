"""Import index documents and the transcripts they name, read from disk."""

import json

from tokentally.operators import rollout
from tokentally.sources import files, schemas


def said(model, kind="assistant", **more):
    return json.dumps({"type": kind, "message": {"role": kind, "model": model}} | more)


def test_later_entry_wins_where_its_transcript_names_a_model(spark, tmp_path):
    home, logs = tmp_path / "host=a" / "home", tmp_path / "host=a" / "logs"
    home.mkdir(parents=True)
    logs.mkdir()
    (logs / "one.jsonl").write_text("\n".join([said("m1"), said("m2"), said("m2"), said("m9", "user"), "{cut", said("<synthetic>")]))
    (logs / "two.jsonl").write_text("\n".join([said("z"), said("b"), json.dumps({"payload": {"type": "assistant", "message": {"model": "b"}}}), json.dumps({"model": "z"})]))
    (logs / "none.jsonl").write_text(said("x", "user"))
    entry = lambda i, name: {"imported_thread_id": i, "source_path": name and str(logs / name)}
    (home / "external_agent_session_imports.json").write_text(json.dumps({"records": [
        entry("t1", "one.jsonl"), entry("t2", "one.jsonl"), entry("t2", "two.jsonl"), entry("t3", "two.jsonl"), entry("t3", "none.jsonl"), entry("t4", "gone.jsonl"),
        entry(" ", "one.jsonl"), entry("t5", None), "text", {"imported_thread_id": "t6", "source_path": "\\\\?\\" + str(logs / "one.jsonl")},
    ]}))
    (home / "sub").mkdir()
    (home / "sub" / "external_agent_session_imports.json").write_text("{cut")
    documents = files.read_bodies(spark, str(home), "external_agent_session_imports.json")
    records = files.parse_records(files.read_lines(spark, str(logs)), schemas.TRANSCRIPT)
    found = rollout.imported_models(rollout.import_entries(documents), records).collect()
    # Of two models with as many lines, the first by name.
    assert sorted((r.host, r.id, r.imported_model) for r in found) == [("a", "t1", "m2"), ("a", "t2", "b"), ("a", "t3", "b"), ("a", "t6", "m2")]
    assert [r.error for r in rollout.import_index_errors(documents).collect()] == ["unreadable_import_index"]
    assert [r.error for r in files.parse_errors(records).collect()] == ["jsonl_line_5"]
