"""Registered queries over the driver tables, each with its SQL twin where one exists."""
