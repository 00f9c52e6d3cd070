"""Operators for preparing training data: ten large-scale corpus jobs and their pipeline."""
