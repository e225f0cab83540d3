"""Plan-time pieces: the criteria grammar, and dealing ordered rows to ranges."""
