"""Lazy DataFrame operators: standardising, allocation, integrity, reports,
planning targets, and the rule checks they produce (see README for the map to
the operator inventory)."""
