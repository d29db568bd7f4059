"""Column functions: distributions, texts, prompts, scores."""
