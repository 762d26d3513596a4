"""DataFrame-to-DataFrame steps: ingest, facts, comparison, reports."""
