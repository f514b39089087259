"""Operators for preparing training text: optional, imported by nothing else here."""
