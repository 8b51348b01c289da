"""Reading, checking and publishing raw snapshot files."""
