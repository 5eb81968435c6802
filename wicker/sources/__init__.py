"""Readers and writers: source trees, histories, traces, stored graphs."""
