"""Readers for histories, patch files and exclusion lists."""
