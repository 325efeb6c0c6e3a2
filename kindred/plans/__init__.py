"""Output shapes, the run store, and whole runs."""
