"""Readers: delimited text, workbooks, warehouse tables, shared scratch tables."""
