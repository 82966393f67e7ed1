"""Training-data operators: quality, mixing, decontamination, chat format, scoring, de-duplication, output."""
