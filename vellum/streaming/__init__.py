"""Structured Streaming deployments."""
