"""Words and context of a stream of key events."""
