"""Reading and writing: JSON Lines, JSON, CSV, Parquet, Markdown, paged services; fingerprints and upserts."""
