"""Temporal edge analytics and link ranking as DataFrame programs."""
