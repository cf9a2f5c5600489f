"""Readers: stored tables as the operators' inputs, and a data source over repositories."""
