"""Plan shapes: grouping sets and ranks over whole tables."""
