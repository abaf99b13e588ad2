"""Registered queries and the domain views they run on."""
