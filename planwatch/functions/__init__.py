"""Column functions: texts, dates, price bands, condition tags."""
