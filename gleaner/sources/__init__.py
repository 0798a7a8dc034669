"""Readers: file listings, CSV tables, page / paged / OCR text, catalog."""
