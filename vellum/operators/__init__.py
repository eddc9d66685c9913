"""Operators over tables of blocks, glyphs, cells, sections and outputs, keyed by doc_id."""
