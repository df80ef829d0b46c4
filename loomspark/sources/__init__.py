"""Seeds: files that become tables and views."""
