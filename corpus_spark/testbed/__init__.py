"""Derives the domain tables from the given star-schema tables, and registers every query."""
