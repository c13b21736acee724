"""Part of logweave: plans."""
