"""Sources, sinks and the views that bind operators to the given tables."""
