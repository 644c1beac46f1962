"""Runnable jobs.  Each has a function that takes a session, a command line and a small configuration beside it."""
