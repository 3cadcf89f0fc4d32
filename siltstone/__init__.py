"""Siltstone: retrieval, graph, reconciliation and task analytics as Spark DataFrame jobs."""
