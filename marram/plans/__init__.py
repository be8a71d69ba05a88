"""Plans that compose operators, and what sessions need to run them."""
