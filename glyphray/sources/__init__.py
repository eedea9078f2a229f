"""Readers and writers: files, headers, configuration, node lists, logs, reports."""
