"""Column expressions shared by batch and streaming plans. No Python UDFs."""
