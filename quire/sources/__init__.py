"""Reading books: plain text, EPUB, PDF by an optional parser, and typed JSON."""
