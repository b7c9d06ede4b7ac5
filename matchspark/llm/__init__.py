"""Operators of a training-data pipeline, each built by one named method."""
