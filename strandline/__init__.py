"""Sequence, interval, graph and phasing analytics as PySpark DataFrame operators."""
