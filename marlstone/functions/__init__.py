"""Column functions: text, arrays, prompts."""
