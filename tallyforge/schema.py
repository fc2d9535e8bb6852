"""Schemas of the canonical tables, as DDL."""

#: One row for each model call or usage event.
USAGE = (
    "source string, timestamp string, timestamp_ms long, date date, message_id string, dedup_scope string, session_key string, "
    "session_id string, project_path string, model string, input_tokens long, output_tokens long, cache_creation long, "
    "cache_creation_1h long, cache_read long, reasoning_tokens long, stop_reason string, cost_kind string, endpoint string, "
    "call_count long, recorded_cost_usd double, file_path string, line_ord long"
)
#: One row for each tool call.
TOOL = "source string, name string, date date, session_key string, message_id string, tool_use_id string"
#: USD for a token.
RATES = ("input", "output", "reasoning_output", "cache_create", "cache_create_1h", "cache_read")
PRICE = "price_key string, " + ", ".join(f"{r} double" for r in RATES)

TOKENS = ("input_tokens", "output_tokens", "cache_creation", "cache_creation_1h", "cache_read", "reasoning_tokens")
#: Tokens that do not overlap; cache_creation_1h is part of cache_creation.
DISJOINT = ("input_tokens", "output_tokens", "cache_creation", "cache_read", "reasoning_tokens")
COLUMNS = [x.split()[0] for x in USAGE.split(", ")]
