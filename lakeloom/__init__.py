"""Composable DataFrame operators for lakehouse pipelines: ingest, chunking, audits, contracts, versions, logs."""
