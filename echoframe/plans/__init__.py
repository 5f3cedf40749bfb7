"""Plans: operators put together, and the tables written between them."""
