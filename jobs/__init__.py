"""Runnable jobs over the library: a command line and a small JSON configuration each."""
