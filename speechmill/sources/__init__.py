"""Readers, writers and the recognizer protocol."""
