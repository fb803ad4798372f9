"""Writing results: text and JSON files, EPUB, stage markers."""
