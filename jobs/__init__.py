"""Runnable jobs over read tables: each is a function that takes a session, and a command line that makes one."""
