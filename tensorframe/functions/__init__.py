"""Column expressions: semirings, saturating and tolerant arithmetic, index arithmetic."""
