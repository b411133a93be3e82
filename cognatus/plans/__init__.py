"""Composite plans: linkage tiers, scoring, the pipeline and its reports."""
