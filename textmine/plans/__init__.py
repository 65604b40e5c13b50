"""The jobs a user calls."""
