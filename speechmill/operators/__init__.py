"""Relational and sequence operators of the engine."""
