"""Batch jobs built from the operators: read, compose one lazy plan, write once."""
