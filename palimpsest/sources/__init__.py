"""Readers and writers: event tables, log segments, runs, command lines, workloads."""
