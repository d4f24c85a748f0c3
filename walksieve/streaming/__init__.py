"""Views kept up to date from append-only logs."""
