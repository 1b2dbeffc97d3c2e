"""Readers of archived API pages, contents, snapshots and events; writers of requests and reports."""
