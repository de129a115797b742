"""Two-way and one-round joins."""
