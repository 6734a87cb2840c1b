"""Functions of the document privacy engine."""
