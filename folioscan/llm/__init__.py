"""Operators of a training-data pipeline. Nothing else in folioscan imports this subpackage."""
