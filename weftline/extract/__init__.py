"""TypeScript and JavaScript source files to graph events."""
