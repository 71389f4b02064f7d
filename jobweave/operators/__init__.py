"""Query operators over job, history, schedule and schema tables."""
