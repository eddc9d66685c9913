"""Document analytics on Spark: blocks, glyphs, cells, sections and audits as DataFrames."""
