"""Column-to-column functions: text cleaning, tokens, vectors. Built-in expressions only, so plans stay in generated code."""
