"""Versioned rule corpora, hybrid retrieval and exact tax computation as Spark jobs."""
