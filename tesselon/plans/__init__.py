"""Whole queries: operators applied to tables, each with equivalent SQL."""
