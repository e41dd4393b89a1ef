"""Writers (word-count text, per-set files, append logs, stats, reports)."""
