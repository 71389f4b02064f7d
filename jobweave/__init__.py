"""Durable-job analytics on Spark: job queues, histories, schedules and training-text operators."""
