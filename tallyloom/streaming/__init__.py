"""Workbooks that arrive in a folder."""
