"""The operators bound to the benchmark tables, each with the SQL that states its result.

A binding reads whole tables, derives the fleet-shaped columns an operator expects from
them, and runs the operator. The SQL next to it computes the same rows independently.
"""
