"""Readers and writers of fleet data."""
