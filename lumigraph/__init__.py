"""Network diffusion, hierarchies of strongly connected components and flows between them, as Spark DataFrames."""
