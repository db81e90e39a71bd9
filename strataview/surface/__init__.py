"""Deployment files, tools and the command line."""
