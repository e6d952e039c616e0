"""Composed jobs and the registered queries with their check SQL."""
