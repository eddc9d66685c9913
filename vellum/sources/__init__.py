"""Sources of blocks and sinks of outputs."""
