"""Query text to algebra, and the planner's view of it."""
