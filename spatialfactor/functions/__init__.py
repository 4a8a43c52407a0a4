"""Numerical helpers of driver and tasks."""
