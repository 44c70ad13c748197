"""Driver-side choices: schema changes, search method."""
