"""Readers, writers, table catalog and the test-data adapter."""
