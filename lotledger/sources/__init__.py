"""Readers, writers and fixed dimensions."""
