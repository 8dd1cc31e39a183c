"""Registered plans over the synthetic tables and their SQL."""
