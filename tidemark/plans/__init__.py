"""Registered queries and the planner of strategy documents."""
