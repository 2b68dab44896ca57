"""Readers and writers of the engine's external forms."""
