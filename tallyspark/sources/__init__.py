"""Readers that turn raw logs and payloads into the canonical tables."""
