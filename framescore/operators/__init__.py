"""Operators: functions from DataFrames to DataFrames. Every table carries system_id and doc_id where it has them, so
one job serves all systems and documents."""
