"""Survival-curve and time-to-event analytics expressed as Spark DataFrame jobs."""
