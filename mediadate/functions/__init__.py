"""Column expressions: paths, dates, sizes, camera fields and date stamps."""
