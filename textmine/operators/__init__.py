"""Relational steps the jobs are made of."""
