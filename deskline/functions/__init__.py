"""Column expressions: texts, numbers, prompts and model answers."""
