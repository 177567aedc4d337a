"""Whole jobs, their command line and the registered queries."""
