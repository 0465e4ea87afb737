"""Registered queries by domain; importing a module registers its queries."""
