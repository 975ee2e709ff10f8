"""Readers and writers of manifests, archives, arrays and reports."""
