"""Plan helpers: intermediate tables, distributed ranking, session settings, resolution flow."""
