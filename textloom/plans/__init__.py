"""Plans that put operators together: reading tables, and whole pipelines."""
