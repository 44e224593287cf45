"""Part of listwright."""
