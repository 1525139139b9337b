"""Schemas and caps in one place."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

# What counts, and where texts are cut.
LINE_BYTES = 50_000
TEXT_CHARS = 2_000
TOOL_RESULT_BYTES = 5_000
TOOL_RESULT_CHARS = 1_500
LABEL_CHARS = 60
EMBED_PROMPTS, EMBED_PROMPT_CHARS, EMBED_LABEL_BYTES = 30, 500, 10
PREVIEW_PROMPTS, PREVIEW_PROMPT_CHARS, PREVIEW_LINES = 10, 200, 500
CHUNK_BYTES, CHUNK_OVERLAP, CHUNK_FROM, CHUNKS = 800, 100, 1_000, 32
CONTEXT_BYTES = 120
SEMANTIC_LEAST, SEMANTIC_TOP = 0.5, 100
NEAR_CHARS = 5
UNTITLED = "untitled"

RAW_LINES = "path string, sid string, line_no bigint, value string, mtime timestamp"
EVENTS = "sid string, line_no bigint, event_type string, event_ts string, branch string, cwd string, title string, texts array<string>, tool_results array<string>, has_content boolean, oversized boolean"
SESSION_COLUMNS = ("sid", "created", "modified", "mtime_epoch", "msg_count", "label", "branch", "project", "cwd", "search_text")
SESSIONS = "sid string, created string, modified string, mtime_epoch bigint, msg_count bigint, label string, branch string, project string, cwd string, search_text string, embedding array<float>"


class SearchMode(Enum):
    EXACT = "exact"
    FUZZY = "fuzzy"
    SEMANTIC = "semantic"

    @classmethod
    def of(cls, name: str | SearchMode) -> SearchMode:
        """Unknown names mean fuzzy."""
        if isinstance(name, cls):
            return name
        return next((m for m in cls if m.value == str(name).lower()), cls.FUZZY)

    def next(self) -> SearchMode:
        order = [SearchMode.EXACT, SearchMode.FUZZY, SearchMode.SEMANTIC]
        return order[(order.index(self) + 1) % 3]


@dataclass(frozen=True)
class FuzzyScoring:
    """Weights of the alignment score; a contiguous match reaches `match` per character."""

    match: int = 16
    gap_open: int = 3
    gap_extend: int = 1
    boundary: int = 8
    boundary_white: int = 10
    boundary_delimiter: int = 9
    camel: int = 5
    consecutive: int = 4
    first_char_factor: int = 2
    least_per_char: int = 16
