"""Training-data operators: mixing, filtering, de-duplication, packing and token files."""
