"""Structured Streaming forms of the operators that suit streams."""
