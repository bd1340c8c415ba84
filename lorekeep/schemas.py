"""Schemas of the engine's tables and rows."""

from __future__ import annotations

PAPER_INFO = "arxiv_id string, title string, authors array<string>, year int, category string, summary string, pdf_url string"
IMPORT_RESULT = "arxiv_id string, title string, success boolean, chunks int, error string"
CATALOG = "id long, arxiv_id string, title string, authors string, year int, category string, pdf_path string, txt_path string, is_vectorized boolean, created_at timestamp"
IMPORT_LOG = "arxiv_id string, category string, status string, error string, created_at timestamp"
MIGRATIONS = "version string, applied_at timestamp"
PAGES = "source string, page int, page_content string, metadata map<string,string>"
CHUNKS = "chunk_id string, source string, arxiv_id string, title string, category string, page int, chunk_index int, page_content string, metadata map<string,string>"
SEARCH_RESPONSE = "id string, title string, authors array<string>, authors_display string, summary string, published string, pdf_url string"
#: Papers to import by category, 1,000 in all (fixed values).
QUOTAS = {"cs.CL": 400, "cs.CV": 300, "cs.LG": 100, "cs.AI": 100, "cs.RO": 100}
