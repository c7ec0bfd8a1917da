"""Column functions: names, hashes, request texts, JSON handling, dates."""

from feedloom.functions.dates import normalize_pub_date, parse_pub_date
from feedloom.functions.jsonfn import (
    DEFAULT_SCHEME, chat_reply, format_transcript, generate_reply, is_json, merge_response,
    parse_asr_response, parse_completion, resolve_scheme, store_request_kind, strip_fence,
)
from feedloom.functions.strings import (
    artifact_glob, artifact_key, audio_name, blank, chat_request, cut_bytes, effective_id,
    empty_to_null, extraction_content, extraction_prompt, generate_request, meta_name,
    raw_name, raw_text, slug, structured_name, transcribe_request, transcription_hint,
    trim_ws, xml_escape,
)

__all__ = [
    "normalize_pub_date", "parse_pub_date", "DEFAULT_SCHEME", "chat_reply", "format_transcript",
    "generate_reply", "is_json", "merge_response", "parse_asr_response", "parse_completion",
    "resolve_scheme", "store_request_kind", "strip_fence", "artifact_glob", "artifact_key",
    "audio_name", "blank", "chat_request", "cut_bytes", "effective_id", "empty_to_null",
    "extraction_content", "extraction_prompt", "generate_request", "meta_name", "raw_name",
    "raw_text", "slug", "structured_name", "transcribe_request", "transcription_hint",
    "trim_ws", "xml_escape",
]
