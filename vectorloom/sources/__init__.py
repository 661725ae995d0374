"""Readers, writers and the artifact store."""
