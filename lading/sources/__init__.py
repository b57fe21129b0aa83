"""Readers and writers of archives and compressed streams."""
