"""Tables in and results out."""
