"""Part of logweave: sources."""
