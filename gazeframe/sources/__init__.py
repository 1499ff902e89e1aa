"""Readers and writers of recordings, tables and configuration."""
