"""How iterative operators are carried out."""
