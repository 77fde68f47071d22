"""Sources: declared model schemas, readers and the test-data binding."""
