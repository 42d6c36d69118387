"""quillspan: exact-range text and byte operators as DataFrame-to-DataFrame functions on Spark."""
