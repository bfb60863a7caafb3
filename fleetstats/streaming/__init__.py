"""Structured Streaming: stateful rates, running views, message ingest, sinks."""
