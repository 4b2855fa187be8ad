"""Readers and writers of scientific file formats."""
