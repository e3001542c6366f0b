"""Answers that keep arriving."""
