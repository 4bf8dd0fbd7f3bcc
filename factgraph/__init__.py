"""Jobs over evidence-backed fact graphs, as DataFrame transformations."""
