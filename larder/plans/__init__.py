"""Registered queries, the views of the test tables that they run on, and their equal SQL."""
