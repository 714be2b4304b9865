"""Table schemas, readers, writers and the binding onto the test tables."""
