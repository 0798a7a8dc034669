"""Composites: ingest, question answering, SQL text."""
