"""Scalar column expressions (built-in Spark functions only)."""

from statcube.functions.scalar import *  # noqa: F401,F403
