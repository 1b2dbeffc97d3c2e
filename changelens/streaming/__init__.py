"""Live event feeds: ingest, claims, releases, rate limits and idempotent publishing."""
