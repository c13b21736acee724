"""Part of logweave: operators."""
