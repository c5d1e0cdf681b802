"""Read-side operators: each takes a Hospital and an explicit as-of date and returns a lazy DataFrame."""
