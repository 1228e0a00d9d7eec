"""Runnable jobs; each file has a function that takes a session, and a command line."""
