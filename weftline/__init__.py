"""Provenance lineage over exported agent traces, as Spark jobs."""
