"""clonoforge: a PySpark engine for T-cell-receptor repertoire data and training-data preparation."""
