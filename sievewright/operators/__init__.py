"""The bitmap index and what it is made of."""
