"""Table operators: preparation, summaries, survey tables, models, chart data."""
