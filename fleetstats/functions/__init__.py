"""Column expressions: number and time formats, threshold classes, labels."""
