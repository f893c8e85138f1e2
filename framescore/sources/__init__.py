"""Readers and writers of the text layouts."""
