"""SQL spellings and scalar rules."""
