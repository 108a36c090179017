"""Readers of lead files and writers of results."""
