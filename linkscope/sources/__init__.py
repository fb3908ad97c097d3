"""Readers of packets, logs and case folders."""
