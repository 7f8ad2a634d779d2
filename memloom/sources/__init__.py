"""Readers and adapters from raw datasets to the memory-question schema, and sinks."""
