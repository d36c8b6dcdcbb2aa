"""Raw, cleaned and dimensional layers over a table store."""
