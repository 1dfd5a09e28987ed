"""Ready plans over the stand-in tables, and whole import runs."""
