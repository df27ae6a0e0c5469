"""Relational, graph and event operators: functions from DataFrames to DataFrames."""
