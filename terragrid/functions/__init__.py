"""Column functions: linear algebra, geodesy, camera models, names and images."""
