"""Sources of entries and contents, and the document sink."""
