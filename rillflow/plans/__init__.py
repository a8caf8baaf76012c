"""Logical plans, their SQL front end, and the two compilers over them."""
