"""Column functions: time, text, URLs, markup and money."""
