"""Frames, windows, deferred expressions and the rewrites applied before Spark plans them."""
