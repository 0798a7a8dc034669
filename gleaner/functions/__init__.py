"""Column-level building blocks: text, markup, facts, chunking, embedding."""
