"""Where rows to validate come from, and where they go."""
