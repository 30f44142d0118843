"""Column functions over paths, texts and names; all native expressions."""
