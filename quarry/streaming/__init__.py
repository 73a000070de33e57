"""Search and evaluation over arriving query files."""
