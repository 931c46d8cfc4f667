"""Table readers, writers and stand-in views."""
