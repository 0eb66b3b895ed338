"""Readers and writers of feeds, and tables in the shared folder."""
