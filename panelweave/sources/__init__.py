"""Readers, writers and result stores."""
