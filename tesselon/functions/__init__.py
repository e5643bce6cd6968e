"""Column functions: identities, text, grid arithmetic, numerical codes and the planar geometry kernel."""
