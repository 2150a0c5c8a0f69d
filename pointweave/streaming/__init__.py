"""Deposits of particle streams."""
