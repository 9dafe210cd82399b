"""Job states and file streams."""
