"""Files and documents as tables, and back."""
