"""How the operators split their work: time slices, staged side tables, and the query catalogue."""
