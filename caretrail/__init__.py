"""Part of the caretrail engine."""
