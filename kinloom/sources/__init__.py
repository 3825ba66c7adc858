"""Readers and writers of graph files; everything is text in folders Spark can reach."""
