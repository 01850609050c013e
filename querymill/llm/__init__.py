"""Training-data pipeline operators.

Nothing outside this subpackage imports it; ``queries`` registers one query
per operator.
"""
