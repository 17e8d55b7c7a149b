"""Scans and sinks: contracts, observations, SQLite files, ledgers, keyed tables."""
