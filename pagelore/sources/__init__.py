"""Adapters from stored tables and plan files to plan tables."""
