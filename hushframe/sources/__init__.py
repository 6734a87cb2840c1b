"""Sources of the document privacy engine."""
