"""Row types, as DDL, for reading and writing with an explicit schema."""

CHUNK = (
    "chunk_id string, doc_id string, source_id string, source_path string, file_type string, text string, chunk_index int, content_hash string, "
    "page_start int, page_end int, heading_path array<string>, normalized_char_start int, normalized_char_end int, extraction_methods array<string>, "
    "warnings array<string>, ingestion_version string, chunking_version string, ingestion_fingerprint string, chunking_fingerprint string"
)
INDEX = CHUNK + ", vector array<double>, norm double"
META = "schema_version int, provider_name string, provider_model string, provider_fingerprint string, dimension int, chunk_count bigint"
FAILURE = "source_path string, error_type string, message string"
SAMPLE = "name string, query string, relevant_chunk_ids array<string>, relevant_source_paths array<string>, min_score double"
TASK = "id string, query string, task_type string, relevant_chunk_ids array<string>, relevant_source_paths array<string>, expected_points array<string>, category string, auto boolean"
RESULT = "query_id bigint, rank int, score double, chunk_id string, doc_id string, source_path string, file_type string, text string, page_start int, page_end int, heading_path array<string>"
TOOL_CALL = "step int, call_id string, name string, arguments string, results array<struct<chunk_id:string,source_path:string>>"
VERDICT = "task_id string, faithfulness int, coverage int, overall int, failure_type string, reason string, error string"
HISTORY = "schema_version int, max_turns int, turns array<struct<user:string,assistant:string>>"
