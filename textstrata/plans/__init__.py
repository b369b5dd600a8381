"""End-to-end jobs and test-table bindings."""
