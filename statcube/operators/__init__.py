"""statcube operators."""
