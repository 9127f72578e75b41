"""Operators for training-data work on texts and names; nothing outside this subpackage imports it."""
