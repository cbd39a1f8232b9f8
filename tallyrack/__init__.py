"""Exact probabilistic and evidence analytics as Spark plans."""
