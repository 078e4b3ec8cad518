"""Readers of captured payloads."""
