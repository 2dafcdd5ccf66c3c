"""Ingest, request counts and latest snapshots as streams."""
