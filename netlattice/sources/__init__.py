"""Readers and writers: manifests, tables, network documents, vendor dumps, text output."""
