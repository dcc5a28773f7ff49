"""Where data comes from and goes to: the versioned store and text files."""
