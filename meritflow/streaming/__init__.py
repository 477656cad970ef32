"""Structured Streaming operators (STM1-STM10)."""
