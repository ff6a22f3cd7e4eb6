"""statcube sources."""
