"""Governance, negotiation and rollups over the declared model."""
