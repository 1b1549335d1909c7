"""Whole queries over tables, with the SQL that gives the same rows."""
