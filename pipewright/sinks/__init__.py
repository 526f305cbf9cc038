"""Results as text or files."""
