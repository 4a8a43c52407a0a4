"""Canonical views, and a query and its SQL for each operator."""
