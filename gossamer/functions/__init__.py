"""Gossamer subpackage."""
