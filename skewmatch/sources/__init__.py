"""Entity sources and the result writer."""
