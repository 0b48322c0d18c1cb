"""Readers and sinks: source trees, commit logs, snapshots, baselines."""
