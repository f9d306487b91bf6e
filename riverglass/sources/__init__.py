"""Readers and writers for logs, traces, profiles and fact tables."""
