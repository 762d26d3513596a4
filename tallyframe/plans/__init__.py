"""The user-level jobs, end to end."""
