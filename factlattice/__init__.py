"""factlattice: evidence, facts and recall analytics as plain Spark DataFrame transformations."""
