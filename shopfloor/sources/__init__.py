"""Input contracts, table loading and the test-table mapping."""
