"""Schemas of the relations, as DDL."""

from __future__ import annotations

RELATIONS: dict[str, str] = {
    "files": "path string, relative_path string, size bigint, extension string, mtime timestamp",
    "elements": "id string, type string, name string, file_path string, relative_path string, language string, start_line int, end_line int, code string, signature string, docstring string, summary string, metadata variant, repo_name string, repo_url string",
    "documents": "doc_id string, path string, language string, source_set array<string>",
    "symbols": "symbol_id string, external_symbol_id string, path string, display_name string, kind string, language string, qualified_name string, signature string, start_line int, start_col int, end_line int, end_col int, source_priority int, source_set array<string>, aliases array<string>, element_id string",
    "occurrences": "occurrence_id string, symbol_id string, doc_id string, role string, start_line int, start_col int, end_line int, end_col int, source string",
    "edges": "edge_id string, src_id string, dst_id string, edge_type string, source string, confidence string, doc_id string, extractor string",
    "index": "indexer_name string, indexer_version string, documents array<struct<path:string,language:string,symbols:array<struct<symbol:string,name:string,kind:string,range:array<int>,signature:string,qualified_name:string>>,occurrences:array<struct<symbol:string,role:string,range:array<int>>>>>",
    "snapshots": "snapshot_id string, repo_name string, branch string, commit_id string, tree_id string, artifact_key string, created_at timestamp, metadata variant",
    "snapshot_refs": "ref_id string, repo_name string, branch string, commit_id string, tree_id string, snapshot_id string, created_at timestamp",
    "index_artifacts": "snapshot_id string, indexer_name string, indexer_version string, artifact_path string, checksum string, created_at timestamp",
    "index_runs": "run_id string, repo_name string, snapshot_id string, branch string, commit_id string, idempotency_key string, status string, error_message string, created_at timestamp, started_at timestamp, completed_at timestamp",
    "run_events": "event_id bigint, run_id string, status string, error_message string, at timestamp",
    "task_events": "event_id bigint, task_id string, status string, at timestamp",
    "manifests": "manifest_id string, repo_name string, ref_name string, snapshot_id string, index_run_id string, published_at timestamp, previous_manifest_id string, status string",
    "projection_layers": "projection_id string, layer string, node_json string",
    "projection_chunks": "projection_id string, chunk_id string, chunk_json string",
    "overviews": "repo_name string, content string, embedding array<float>, structure_text string, has_readme boolean, repo_url string",
    "file_manifest": "path string, mtime timestamp, size bigint, element_ids array<string>",
    "turns": "session_id string, turn_number int, timestamp timestamp, query string, answer string, summary string, multi_turn boolean",
    "cache": "key string, value binary, stored_at timestamp, expires_at timestamp",
    "chat_messages": "session_id string, ord bigint, role string, content string, timestamp timestamp",
    "jobs": "id string, name string, enabled boolean, kind string, at_ms bigint, every_ms bigint, expr string, tz string, next_run_at_ms bigint, last_run_at_ms bigint, last_status string, delete_after_run boolean",
    "messages": "channel string, sender string, chat_id string, content string, at timestamp",
}


def empty(spark, relation: str):
    """An empty table of a relation."""
    return spark.createDataFrame([], RELATIONS[relation])
