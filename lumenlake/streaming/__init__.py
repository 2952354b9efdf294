"""Structured Streaming: change watching, debouncing and job states."""
