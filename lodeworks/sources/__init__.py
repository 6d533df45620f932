"""Readers, the catalog of tables and the snapshot store."""
