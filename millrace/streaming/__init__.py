"""Streaming queries. Importing this registers them."""

from millrace.streaming import windows  # noqa: F401
