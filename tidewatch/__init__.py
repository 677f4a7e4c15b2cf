"""Bursts, triggers and reports over timestamped, keyed events, as Spark jobs."""
