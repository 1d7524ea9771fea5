"""Part of the fact engine."""
