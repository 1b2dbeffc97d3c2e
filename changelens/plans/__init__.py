"""Composite jobs over whole tables: many repositories and commits in one run."""
