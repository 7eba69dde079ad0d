"""Community matching, points ledger, preferences and delivery as Spark jobs."""

__version__ = "0.1.0"
