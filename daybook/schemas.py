"""Table schemas of the sources and sinks."""

COMMIT = (
    "seq BIGINT, repo STRING, hash STRING, author_email STRING, committed_at TIMESTAMP_NTZ, "
    "tz_offset_min INT, message STRING"
)
COMMIT_FILE = (
    "seq BIGINT, pos INT, a_path STRING, b_path STRING, insertions BIGINT, deletions BIGINT"
)
HISTORY = (
    "id BIGINT, created_at TIMESTAMP_NTZ, commit_hash STRING, provider STRING, model STRING, "
    "tone STRING, standup_text STRING, repos STRING, hours_lookback INT, quality_score INT"
)
CALL = "call_id BIGINT, user_id BIGINT, ts TIMESTAMP_NTZ"
