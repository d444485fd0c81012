"""The same rules and histories over streams."""
