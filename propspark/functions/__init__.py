"""Column expressions: ingest, odds, rates. No input or output, no Python per row except where noted."""
