"""Schemas of the ledger's logs. ``batch`` and ``seq`` order entries; ``op`` says what an entry does."""

from __future__ import annotations

# Columns and types of the ledger tables.
TABLES = {
    "runs": "session_id string, script_path string, script_hash string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, exit_code int, "
            "parent_session string, combined_hash string, metadata string, provenance string, exception_reason string",
    "file_hashes": "session_id string, file_path string, hash string, role string, size_bytes bigint, frozen boolean, host string, recorded_at timestamp_ntz, node_class string",
    "session_parents": "session_id string, parent_session string, recorded_at timestamp_ntz",
    "verification_results": "session_id string, verified_at timestamp_ntz, level string, status string",
    "claims": "claim_id string, file_path string, line_number int, claim_type string, claim_value string, source_session string, source_file string, source_hash string, "
              "registered_at timestamp_ntz, verified_at timestamp_ntz, status string",
    "citations": "cite_key string, manuscript_file string, line_number int, doi string, source_id string, resolved boolean, is_stub boolean, status string, metadata_json string, "
                 "metadata_hash string, url string, registered_at timestamp_ntz, verified_at timestamp_ntz",
    "stamps": "stamp_id string, root_hash string, timestamp string, backend string, service_url string, response_token string, run_count int, session_ids array<string>",
    "stamp_sessions": "stamp_id string, session_id string",
}
#: What identifies a row of each table; verification results and stamps only grow.
KEYS = {
    "runs": ("session_id",), "file_hashes": ("session_id", "file_path", "role"), "session_parents": ("session_id", "parent_session"),
    "claims": ("claim_id",), "citations": ("cite_key",), "verification_results": ("batch", "seq"), "stamps": ("stamp_id",), "stamp_sessions": ("stamp_id", "session_id"),
}
#: Tables of which every entry counts.
GROWING = ("verification_results", "stamps", "stamp_sessions")
ORDER = "batch bigint, seq bigint, op string"


def log_schema(table: str) -> str:
    return f"{TABLES[table]}, {ORDER}"


def columns(table: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in TABLES[table].split(", ")]
