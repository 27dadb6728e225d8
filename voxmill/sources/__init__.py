"""Readers for landed files and normalisers for raw payloads."""
