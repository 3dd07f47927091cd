"""Relational operators over files, findings and rules."""
