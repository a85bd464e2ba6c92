"""Column helpers: dates, numbers, text formatting, arg-max with a tie rule."""
