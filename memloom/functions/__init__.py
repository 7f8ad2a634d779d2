"""Column expressions: text, extraction, judging, spans, prompts and rules."""
