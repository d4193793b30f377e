"""Column expressions and the small numeric helpers used on result rows."""
