"""Reads as declared plans: filters, and the four verbs over governed tables."""
