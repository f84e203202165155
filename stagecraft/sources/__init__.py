"""Sources: stages (file directories) and tables."""
