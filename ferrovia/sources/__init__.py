"""Readers and writers of feeds, graphs and reference tables."""
