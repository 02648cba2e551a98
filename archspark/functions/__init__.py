"""Column functions: text, paths, and what is found inside source files."""
