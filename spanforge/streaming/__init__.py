"""Nothing yet: all operators work on whole, finished recordings."""
