"""Training-data operators. Nothing outside this subpackage imports it, except the guard in ``__spark_entry__``."""
