"""Column functions: keys, periods, masking, JSON validation."""
