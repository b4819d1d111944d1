"""Shared plan pieces: column checks, last-per-key, positions in a total order."""
