"""Column functions and the pure functions behind UDFs."""
