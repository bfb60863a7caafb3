"""Readers of landed telemetry and the message envelope."""
