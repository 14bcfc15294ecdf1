"""Scalar column functions with labelled-table null rules."""
