"""Subpackage of the engine; see the README."""
