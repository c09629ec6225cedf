"""Operators for preparing training text: one module for each, and their queries in ``queries``."""
