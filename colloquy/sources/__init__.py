"""Reading the input tables and registering artifacts."""
