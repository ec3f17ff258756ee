"""Relations of responses and redirects."""
