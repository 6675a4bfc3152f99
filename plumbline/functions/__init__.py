"""Column functions and statistics, named by their rule."""
