"""Reusable DataFrame operators: grouped, ordered, joined, measured."""
