"""Plans of the document privacy engine."""
