"""Readers and the derived views the operators run over."""
