"""Part of logweave: functions."""
