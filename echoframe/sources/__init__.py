"""Readers that turn stored data into input tables."""
