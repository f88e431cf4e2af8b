"""Schemas of the index's tables and of search results."""

NOTES = "path string, abs_path string, modified timestamp, length bigint, content string"
MANIFEST = "path string, content_hash string"
CHUNKS = "path string, title string, tags string, chunk_ix int, text string, start_line int, end_line int, heading string, body_line_offset int"
VECTORS = "path string, title string, tags string, heading string, start_line int, end_line int, text string, body_line_offset int, embedding array<float>"
FTS_DOCS = "path string, title string, body string, tags string"
POSTINGS = "field string, term string, path string, positions array<int>, bucket int"
LENGTHS = "field string, path string, length int"
LINKS = "source_path string, target_path string, context string"
RESULTS = "path string, title string, chunk string, score double, start_line int, end_line int, tags array<string>, heading string, match_type string"
LINKED = "path string, title string, related_to string"
