"""Relational operators over files, indicators, requests and vectors."""
