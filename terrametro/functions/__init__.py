"""Column expressions; everything here stays inside whole-stage code generation
unless its docstring says otherwise."""
