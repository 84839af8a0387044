"""Readers, writers and the shared-storage stage cut."""
