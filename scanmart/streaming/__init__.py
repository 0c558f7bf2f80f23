"""Structured Streaming forms of ingest, cost roll-up, account refresh and de-duplication."""
