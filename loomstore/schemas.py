"""Schemas and constants of the memory engine."""

from __future__ import annotations

MEMORY = "id string, topic string, summary string, importance string, weight double, access_count long, keywords array<string>, related_ids array<string>, raw_excerpt string, embedding array<float>, created_at timestamp, updated_at timestamp, last_accessed timestamp, summary_hash string"
CONCEPT = "id string, memoir_id string, name string, definition string, labels array<struct<namespace:string,value:string>>, confidence double, revision long, source_memory_ids array<string>, created_at timestamp, updated_at timestamp"
LINK = "id string, source_id string, target_id string, relation string, weight double, created_at timestamp"
MEMOIR = "id string, name string, description string, created_at timestamp, updated_at timestamp"
FACT = "id string, entity string, key string, value string, source string, created_at timestamp, superseded_at timestamp"
SESSION = "id string, agent string, project string, started_at timestamp, updated_at timestamp, metadata string"
MESSAGE = "id string, session_id string, role string, content string, tool_name string, tokens long, ts timestamp, metadata string"
FEEDBACK = "id string, topic string, context string, predicted string, corrected string, reason string, source string, created_at timestamp, applied_count long"
HOOK_EVENT = "id long, ts timestamp, event string, duration_ms long, exit_code int, session_id string, project string, note string"
CODE_AREA = "project string, file_path string, description string, touch_count long, first_touched timestamp, last_touched timestamp, session_id string, tool_name string"
PENDING = "id string, project string, tool_name string, raw_output string, captured_at timestamp"
TOUCH = "id string, times long, at timestamp"
METADATA = "key string, value string"
HOOK_HOUR = "event string, hour timestamp, n long, errors long, timed long, total_ms long, sketch binary"
TABLES = {"memories": MEMORY, "concepts": CONCEPT, "links": LINK, "memoirs": MEMOIR, "facts": FACT, "sessions": SESSION, "messages": MESSAGE, "feedback": FEEDBACK, "hook_events": HOOK_EVENT, "hook_hours": HOOK_HOUR, "code_areas": CODE_AREA, "pending": PENDING, "touches": TOUCH, "metadata": METADATA}

# Importance, from low to high.
IMPORTANCE = ("low", "medium", "high", "critical")
# Relations of concept links.
RELATIONS = ("part_of", "depends_on", "related_to", "contradicts", "refines", "alternative_to", "caused_by", "instance_of", "superseded_by")

# Limits of inputs and results, thresholds.
MAX_KEYWORDS, MAX_LIMIT, MAX_HYBRID, MAX_TOKENS, MAX_QUERY_BYTES = 50, 100, 1000, 100, 10_000
MAX_TOPIC_BYTES, MAX_SUMMARY_BYTES = 256, 64 * 1024
MIN_DIMS, MAX_DIMS = 64, 4096
LIST_LIMIT, TOPIC_LIMIT, MEMOIR_LIMIT = 10_000, 500, 500
DUPLICATE_SCORE, LINK_SCORE, MAX_LINKS = 0.85, 0.75, 5
AUTO_DECAY, CONSOLIDATE_AT = 0.95, 10

# Vector lengths of embedding models.
MODEL_DIMS = {
    "all-MiniLM-L6-v2": 384,
    "all-MiniLM-L12-v2": 384,
    "bge-small-en-v1.5": 384,
    "multilingual-e5-small": 384,
    "paraphrase-multilingual-MiniLM-L12-v2": 384,
    "bge-base-en-v1.5": 768,
    "multilingual-e5-base": 768,
    "paraphrase-multilingual-mpnet-base-v2": 768,
    "bge-small-zh-v1.5": 768,
    "gte-base-en-v1.5": 768,
    "jina-embeddings-v2-base-code": 768,
    "nomic-embed-text-v1": 768,
    "nomic-embed-text-v1.5": 768,
    "bge-large-en-v1.5": 1024,
    "multilingual-e5-large": 1024,
    "mxbai-embed-large-v1": 1024,
    "bge-large-zh-v1.5": 1024,
    "gte-large-en-v1.5": 1024,
    "modernbert-embed-large": 1024,
    "clip-ViT-B-32": 512,
}
# What stands before texts for models of the E5 family.
E5_PREFIXES = {"query": "query: ", "passage": "passage: "}
# Kinds of semantic anchors, with the importance of what they find.
ANCHORS = {"decision": "high", "bugfix": "high", "preference": "high", "constraint": "high", "milestone": "medium", "architecture": "medium", "performance": "medium"}
