"""Column functions: each takes and gives Columns, and stays in the JVM unless its docstring says otherwise."""
