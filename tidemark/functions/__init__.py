"""See README.md for the list of what lies here."""
