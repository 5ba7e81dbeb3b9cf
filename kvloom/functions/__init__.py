"""Column builders: slots, globs, ranges and number text."""
