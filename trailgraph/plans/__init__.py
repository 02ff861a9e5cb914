"""Answers composed from several operators, and the registered queries."""
