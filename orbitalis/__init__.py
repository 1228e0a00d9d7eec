"""Hierarchical N-body analytics as DataFrame operators.

Bodies, cells, links and interactions are tables; a step of a simulation is a
query over them.  Subpackages: functions (column expressions), sources (readers,
generators, writers), operators (table to table), plans (simulation loops and
the query catalog), streaming (see there).
"""
