"""Part of logweave: streaming."""
