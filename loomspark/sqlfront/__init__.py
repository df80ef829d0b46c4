"""SQL front end: scanning, templates, references, dialect rewriting, scripts."""
