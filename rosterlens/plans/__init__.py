"""Load, change-tracking and materialisation plans (bronze, silver, gold, summaries)."""
