"""Table layout, retention, compaction, statistics and exports."""
