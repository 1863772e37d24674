"""Runnable jobs over the given tables: each a function of a session, and a command line."""
