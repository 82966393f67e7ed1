"""Readers, file audits, catalogs and sinks."""
