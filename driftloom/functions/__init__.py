"""Part of driftloom."""
