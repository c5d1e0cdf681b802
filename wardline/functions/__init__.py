"""Column builders: dates, money, ordering, sanitising, validation rules, error classes."""
