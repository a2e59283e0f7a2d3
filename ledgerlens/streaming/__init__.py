"""Structured Streaming: scoring and monitoring with fitted artefacts only."""
