"""Column expressions with the null and division rules every feature shares."""
