"""Readers: adapter views over tables, OCR and layout JSON, prompts, configuration."""
