"""Types and literals of the dialect."""
