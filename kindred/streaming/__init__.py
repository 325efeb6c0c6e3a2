"""Files that arrive in a folder, run batch by batch."""
