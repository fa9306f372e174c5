"""Spark jobs that find, classify, hide, restore and audit credentials in tables of files, text and logs."""
