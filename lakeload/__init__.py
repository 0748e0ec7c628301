"""Relational-to-lake loading on Spark: sources, checks, quarantine, snapshots, catalog and reports."""
