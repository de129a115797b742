"""Named tables and their files."""
