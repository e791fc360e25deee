"""Scans and sinks: landed tables, text tables, edge lists, score files, topic models."""
