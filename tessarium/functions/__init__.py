"""Native column functions over text, vectors and names."""
