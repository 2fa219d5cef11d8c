"""Byte-level codecs. Plain Python and numpy; nothing here imports Spark."""
