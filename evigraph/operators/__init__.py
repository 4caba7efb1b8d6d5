"""Relational, graph, planning, rule, grading and statistics operators over DataFrames."""
