"""Structured Streaming jobs.

Users, preferences, cache entries and presence keep one row per key in Spark's state store
(``keyed``); delivery is a join of two streams; scores use Spark's streaming aggregate. Output goes
through Spark's file sink, or to one partition per micro-batch that a replay overwrites (``sinks``).
"""
