"""Schema, conditions and intervals: what a query says, before any row is read."""
