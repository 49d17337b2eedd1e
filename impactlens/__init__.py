"""Telematics crash analytics on Spark: DataFrame/SQL/Structured Streaming
jobs that ingest telemetry messages, enrich them, detect and classify
crashes under two rule profiles, build reports, archive and summarise."""

__version__ = "0.1.0"
