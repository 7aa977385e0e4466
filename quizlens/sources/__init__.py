"""Readers, writers, and the derivation of funnel inputs from generic tables."""
