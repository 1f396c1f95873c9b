"""No streaming operators: the behaviour that this library reproduces has none."""
