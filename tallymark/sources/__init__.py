"""Files into flat, typed tables, and rows into existing tables."""
