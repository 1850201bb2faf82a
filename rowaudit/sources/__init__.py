"""Reading table pairs, writing results, and the derived fixtures."""
