"""Queries over the driver tables, with their oracles; importing the package registers all of them."""

from lectern.plans import catalogue, inspection, stored  # noqa: F401
