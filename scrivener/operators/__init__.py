"""Operators over documents, pages and archives."""
