"""What to compute: recipes, fitted parameters, and the passes that fit them."""
